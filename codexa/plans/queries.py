"""The library's queries over the driver's tables, each beside its SQL.

There are no listings of audio files among the tables, so each operator takes
the table that has its shape: order lines are tracks of a set, orders are
sets, documents are files, pages have paths, events are progress and history.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import editions, files, graph, matching, naming, tracks
from ..sources import sidecars
from ..sources.shared import spread
from ..sources.tables import table
from ..streaming import progress

#: Parts of a brand and type, about, that a lot has; each lot meets them all.
YEAR_LOT = 16384

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark, d):
    """Tracks: a set's lines, with a number that orders equal ones."""
    return table(spark, d, "lineitem").withColumn("ord", F.concat_ws("|", F.lpad("l_linenumber", 3, "0"), F.lpad("l_partkey", 9, "0"), F.lpad("l_suppkey", 9, "0"), F.lpad((F.col("l_quantity")).cast("long").cast("string"), 4, "0"), F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0")))


L = """l AS (SELECT *, concat_ws('|', lpad(CAST(l_linenumber AS VARCHAR), 3, '0'), lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 4, '0'), lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0')) AS ord FROM lineitem)"""


# -- editions --------------------------------------------------------------


@query("""
SELECT doc_id, concat_ws('|', lang, source) AS edition, first_value(doc_id) OVER w AS keeper,
    CASE WHEN row_number() OVER w = 1 THEN NULL
         WHEN has_id < first_value(has_id) OVER w THEN 'has_id'
         WHEN clean < first_value(clean) OVER w THEN 'clean'
         WHEN n_chars < first_value(n_chars) OVER w THEN 'n_chars' ELSE 'doc_id' END AS reason
  FROM (SELECT d.doc_id, lang, source, n_chars, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS has_id, coalesce(quality, 0) AS clean
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  WINDOW w AS (PARTITION BY lang, source ORDER BY has_id DESC, clean DESC, n_chars DESC, doc_id)""")
def edition_keeper(spark, d):
    """A3, W3, P-S32: group, score, keep the best, say why others lose."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    scored = docs.join(labels, F.col("doc_id") == F.col("label_id"), "left")
    scored = scored.withColumn("has_id", F.col("label_id").isNotNull().cast("int")).withColumn("clean", F.coalesce("quality", F.lit(0)))
    kept = editions.keepers(scored, ["lang", "source"], ["has_id", "clean", "n_chars"], "doc_id")
    reason = F.when(F.col("reason") == "order", "doc_id").otherwise(F.col("reason"))
    return kept.select("doc_id", F.concat_ws("|", "lang", "source").alias("edition"), "keeper", reason.alias("reason"))


@query("""
WITH t AS (SELECT l_orderkey AS book, CAST(l_linenumber % 2 AS INTEGER) AS disc, (l_linenumber + 1) // 2 AS i, l_quantity AS s, CAST(floor(l_discount * 100) AS INTEGER) AS rate,
    CASE l_suppkey % 9 WHEN 0 THEN 8 WHEN 1 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS rank, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS code FROM lineitem),
d AS (SELECT book, disc, list_sort(list(i)) = range(1, count(*) + 1) AS ok FROM t GROUP BY ALL), o AS (SELECT book, bool_and(ok) AS ok FROM d GROUP BY book),
c AS (SELECT DISTINCT o_orderkey AS book FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT t.book, max(rank) AS format_rank, max(code) AS has_id, CASE WHEN any_value(ok) THEN 1 ELSE 0 END AS clean_order, CASE WHEN t.book IN (SELECT book FROM c) THEN 1 ELSE 0 END AS has_cover,
    coalesce(sum(rate) FILTER (WHERE rate > 0) // nullif(count(*) FILTER (WHERE rate > 0), 0), 0) AS mean_bitrate, CAST(floor(sum(s)) AS BIGINT) AS total_duration FROM t JOIN o ON t.book = o.book GROUP BY t.book),
s AS (SELECT g.*, o_custkey AS edition FROM g JOIN orders ON book = o_orderkey)
SELECT book, edition, format_rank, has_id, clean_order, has_cover, mean_bitrate, total_duration, first_value(book) OVER w AS keeper,
  CASE WHEN row_number() OVER w = 1 THEN NULL WHEN format_rank < first_value(format_rank) OVER w THEN 'lower format rank' WHEN has_id < first_value(has_id) OVER w THEN 'no ISBN/ASIN' WHEN clean_order < first_value(clean_order) OVER w THEN 'track order issues'
    WHEN has_cover < first_value(has_cover) OVER w THEN 'no cover art' WHEN mean_bitrate < first_value(mean_bitrate) OVER w THEN 'lower bitrate' WHEN total_duration < first_value(total_duration) OVER w THEN 'shorter duration' ELSE 'tie-broken by position' END AS reason
FROM s WINDOW w AS (PARTITION BY edition ORDER BY format_rank DESC, has_id DESC, clean_order DESC, has_cover DESC, mean_bitrate DESC, total_duration DESC, book)""")
def edition_scores(spark, d):
    """An edition's six criteria from its tracks, the keeper by them, and why others lose."""
    kinds = F.array(*[F.lit(k) for k in ("m4b", "M4A", "flac", "opus", "ogg", "mp3", "aac", "wav", "xyz")])
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("book"), (F.col("l_linenumber") % 2).alias("disc"), F.floor((F.col("l_linenumber") + 1) / 2).alias("track_index"), F.col("l_quantity").alias("duration"),
        F.floor(F.col("l_discount") * 100).alias("bitrate"), F.get(kinds, (F.col("l_suppkey") % 9).cast("int")).alias("format"), (F.col("l_returnflag") == "A").cast("int").alias("has_id"),
    )
    o = table(spark, d, "orders")
    s = editions.scores(t, "book", o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("book")))
    s = s.join(o.select(F.col("o_orderkey").alias("book"), F.col("o_custkey").alias("edition")), "book")
    kept = editions.keepers(s, ["edition"], list(editions.CRITERIA), "book")
    said = F.create_map(*[F.lit(x) for kv in editions.CRITERIA.items() for x in kv])
    return kept.withColumn("reason", F.when(F.col("reason").isNotNull(), F.coalesce(F.try_element_at(said, F.col("reason")), F.lit(editions.TIED))))


@query("""
SELECT doc_id, n_chars, n, keeper, doc_id <> keeper AS redundant FROM (
  SELECT doc_id, n_chars, count(*) OVER (PARTITION BY n_chars, sha256(text)) AS n, min(doc_id) OVER (PARTITION BY n_chars, sha256(text)) AS keeper FROM documents)
WHERE n > 1""")
def byte_dupes_staged(spark, d):
    """Size, then head and tail, then everything."""
    return files.byte_duplicates(table(spark, d, "documents"), "doc_id", "n_chars", "text").select("doc_id", "n_chars", "n", "keeper", "redundant")


@query("""
SELECT sum(n_chars) FILTER (WHERE doc_id <> keeper) AS reclaimable, count(*) FILTER (WHERE doc_id <> keeper) AS n_redundant, count(DISTINCT keeper) AS n_groups FROM (
  SELECT doc_id, n_chars, count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper FROM documents) WHERE n > 1""")
def reclaimable_bytes(spark, d):
    """What removing redundant files frees."""
    dupes = files.byte_duplicates(table(spark, d, "documents"), "doc_id", "n_chars", "text")
    return dupes.agg(F.sum(F.when(F.col("redundant"), F.col("n_chars"))).alias("reclaimable"), F.count_if("redundant").alias("n_redundant"), F.count_distinct("keeper").alias("n_groups"))


@query("""
WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL),
t AS (SELECT l_orderkey, max(n) AS m, sum(n) AS s, arg_max(l_returnflag, n) AS v FROM n GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN 2 * m > s THEN v END AS winner FROM t""")
def majority_vote(spark, d):
    """The value of over half the tracks."""
    return editions.majority(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query(f"""
WITH {L}, h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord, l_returnflag) AS rn FROM l)
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS agreed FROM h WHERE rn <= 5 GROUP BY l_orderkey""")
def consistent_first5(spark, d):
    """What the first five tracks agree on."""
    return editions.consistent(_lines(spark, d), "l_orderkey", "l_returnflag", ["ord", "l_returnflag"])


@query("""
SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total, max(l_quantity) AS longest, count(*) >= 3 AND sum(l_quantity) > 2.5 * max(l_quantity) AS is_partition
FROM lineitem GROUP BY l_orderkey""")
def segment_guards(spark, d):
    """F24, P-M8: sets whose items are parts of one work."""
    return editions.partitioned_set(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")


def _edition_keys(spark, d):
    """Distinct keys of title and author; every seventh author is unknown, every fifth title has a word more, some a letter less."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    title = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(k % 5 == 0, " unabridged").when(k % 11 == 0, "s").otherwise(""))
    author = F.when(k % 7 == 0, "").otherwise(F.concat(F.lower("p_brand"), F.lit(" writer")))
    return p.groupBy(title.alias("title"), author.alias("author")).agg(F.min("p_partkey").alias("ord"))


@query()
def fuzzy_editions(spark, d):
    """J2, T2, T3, UD2, F13: keys whose titles and authors are alike, each with the first seed that recruits it."""
    keys = _edition_keys(spark, d)
    return editions.greedy_groups(keys, editions.similar_pairs(keys))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, b FROM part JOIN (SELECT p_name AS n, p_size AS s, min(p_partkey) AS b FROM part GROUP BY ALL) ON p_name = n AND p_size = s
    UNION SELECT p_partkey, b FROM part JOIN (SELECT p_retailprice AS n, p_brand AS s, min(p_partkey) AS b FROM part GROUP BY ALL) ON p_retailprice = n AND p_brand = s),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node HAVING min(root) <> node""")
def edition_components(spark, d):
    """UD3: components of parts that share name and size, or price and brand."""
    p = table(spark, d, "part")
    ties = []
    for by in (["p_name", "p_size"], ["p_retailprice", "p_brand"]):
        ties.append(p.join(p.groupBy(*by).agg(F.min("p_partkey").alias("b")), by).select(F.col("p_partkey").alias("a"), "b"))
    return graph.components(ties[0].unionByName(ties[1])).select("node", "root")


# -- tracks ----------------------------------------------------------------


@query("""
WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS have, count(*) AS n, count(DISTINCT l_linenumber) AS dn FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, dn < n AS has_duplicates, array_to_string(list_filter(range(1, n + 1), lambda x: NOT list_contains(have, CAST(x AS INTEGER))), ',') AS missing FROM g""")
def track_order_issues(spark, d):
    """Gaps and repeats in numbering."""
    return tracks.order_issues(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
SELECT l_orderkey, count(*) AS n_tracks, greatest(count(DISTINCT l_suppkey), 1) AS n_discs, nullif(sum(l_quantity), 0) AS duration FROM lineitem GROUP BY l_orderkey""")
def set_totals(spark, d):
    """Tracks, discs and duration."""
    return tracks.totals(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_suppkey")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, round(m, 6) AS mean_quantity FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE m > 0 AND abs(l_quantity - m) > 0.25 * m""")
def bitrate_outliers(spark, d):
    """Rates far off the set's mean."""
    return tracks.outliers(table(spark, d, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", F.round("mean", 6).alias("mean_quantity"))


@query("""
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS l_linestatus
FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND (count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1)""")
def inconsistent_tags(spark, d):
    """Sets that disagree on album or artist."""
    return tracks.inconsistent(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("""
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS formats FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1""")
def format_mix(spark, d):
    """Sets of several formats."""
    return tracks.inconsistent(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag"]).withColumnRenamed("l_returnflag", "formats")


@query("""
WITH g AS (SELECT lower(trim(p_brand)) AS series, list(DISTINCT p_size) AS have FROM part GROUP BY 1),
m AS (SELECT series, len(have) AS n_have, list_sort(list_filter(range(list_min(have), list_max(have) + 1), lambda x: NOT list_contains(have, CAST(x AS INTEGER)))) AS missing FROM g)
SELECT series, n_have, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) > 0""")
def series_gaps(spark, d):
    """Volumes that are missing in between."""
    return tracks.series_gaps(table(spark, d, "part"), "p_brand", "p_size")


CLOCK = "CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')"


@query(f"""
SELECT conv_id, turn, ord, start_ms, end_ms, 'Chapter ' || ord AS title, {CLOCK} AS shown FROM (
  SELECT *, start_ms // 1000 AS s, CASE WHEN ms > 0 THEN start_ms + ms END AS end_ms FROM (
    SELECT conv_id, turn, ms, CAST(row_number() OVER w AS INTEGER) AS ord, CAST(coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
    FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) * 1000 AS ms FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))""")
def chapter_offsets(spark, d):
    """W1, W9, P-D5: offsets from the lengths before."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text").cast("long") * 1000).alias("ms"))
    c = tracks.chapter_offsets(turns, "conv_id", ["turn"], "ms")
    return c.select("conv_id", "turn", "ord", "start_ms", "end_ms", F.concat(F.lit("Chapter "), F.col("ord")).alias("title"), X.clock(F.col("start_ms")).alias("shown"))


@query("""
SELECT event_id, user_id, epoch_us(ts) // 1000 AS start_ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS end_ms FROM events""")
def chapter_ends(spark, d):
    """The next start is the end."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_millis("ts").alias("start_ms"))
    return tracks.chapter_ends(e, "user_id", "start_ms", "event_id")


@query("""
SELECT conv_id, turn, lpad(CAST(n // 75 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // 75 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 75 AS VARCHAR), 2, '0') AS cue
FROM (SELECT conv_id, turn, (length(text) % 5000) * 75 AS n FROM conversations)""")
def cue_times(spark, d):
    """K7, P-M6: mm:ss:ff at 75 frames."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.frames((F.length("text") % 5000).cast("long") * 1000).alias("cue"))


@query("""
WITH RECURSIVE m AS (SELECT user_id, ((epoch_ms(ts) / 1000.0 - 1704067200.0) + (epoch_ms(ts) / 1000.0 - 1704067200.0 + value)) / 2 AS mid FROM events WHERE (epoch_ms(ts) / 1000.0 - 1704067200.0 + value) - (epoch_ms(ts) / 1000.0 - 1704067200.0) >= 3.0),
r AS (SELECT DISTINCT user_id, 0.0::DOUBLE AS last, 0::BIGINT AS n FROM events
  UNION ALL SELECT r.user_id, min(m.mid), any_value(r.n) + 1 FROM r JOIN m ON m.user_id = r.user_id AND m.mid - r.last >= 3600 GROUP BY r.user_id)
SELECT user_id, max(n) AS n_cuts, floor(CASE WHEN max(n) > 0 THEN max(last) END) AS last_cut FROM r GROUP BY user_id""")
def silence_breaks(spark, d):
    """Breaks that keep their distance from the last accepted one."""
    e = table(spark, d, "events").select("user_id", (F.unix_millis("ts") / 1000.0 - 1704067200.0).alias("s"), "value")
    cuts = tracks.silence_breaks(e.withColumn("e", F.col("s") + F.col("value")), "user_id", "s", "e", gap=3600.0)
    return cuts.select("user_id", F.size("cuts").cast("long").alias("n_cuts"), F.floor(F.element_at("cuts", -1)).cast("double").alias("last_cut"))


# -- plans and files ---------------------------------------------------------


@query("""
SELECT page_id, dest, CAST(row_number() OVER w AS INTEGER) AS claim, first_value(page_id) OVER w AS holder
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS dest FROM pages) WINDOW w AS (PARTITION BY lower(dest) ORDER BY page_id)""")
def dest_collisions(spark, d):
    """The first to claim a destination holds it."""
    moves = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("dest"))
    return files.claims(moves, "dest", "page_id").select("page_id", "dest", "claim", "holder")


@query("""SELECT lower(p_name) AS target, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1""")
def dup_targets(spark, d):
    """Targets that several moves share."""
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("target")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).filter("n > 1")


@query("""
WITH r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)/', 1) AS root FROM pages WHERE page_id % 3 = 0),
m AS (SELECT page_id, arg_max(root, length(root)) AS root FROM pages, r WHERE root <> '' AND (split_part(url, '?', 1) = root OR starts_with(split_part(url, '?', 1), root || '/')) GROUP BY page_id)
SELECT p.page_id, coalesce(m.root, 'default') AS root FROM pages p LEFT JOIN m ON p.page_id = m.page_id""")
def longest_prefix_root(spark, d):
    """J10, J11, P-A5: the deepest root over a path."""
    pages = table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("path"), "url")
    roots = pages.filter("page_id % 3 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)/", 1).alias("root")).filter("root <> ''")
    found = files.deepest_root(pages.select("path").distinct(), "path", roots, "root", "default")
    return pages.select("page_id", "path").join(found, "path").select("page_id", "root")


@query("""
SELECT page_id, name FROM (SELECT page_id, split_part(split_part(url, '?', 1), '/', -1) AS name FROM pages)
WHERE NOT (lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('mp3','m4a','m4b','flac','ogg','opus','aac','wav','nfo','cue','json','opf','xml','txt','log')) AND NOT starts_with(name, '.')
  AND NOT (lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ('jpg','jpeg','png','bmp','gif','webp') AND lower(regexp_replace(name, '\\.[^.]+$', '')) IN ('cover','folder','front','albumart','artwork','thumb'))""")
def orphan_files(spark, d):
    """files that belong to nothing."""
    p = table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("path"))
    return files.orphans(p, "path").select("page_id", files.name_of(F.col("path")).alias("name"))


@query("""SELECT page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') AS safe_name, regexp_matches(url, '[<>:"|?*\\\\]') AS unsafe FROM pages""")
def unsafe_names(spark, d):
    """F5, P-S23: characters that file systems refuse."""
    return table(spark, d, "pages").select("page_id", X.file_name(F.col("url")).alias("safe_name"), F.col("url").rlike(r'[<>:"|?*\\]').alias("unsafe"))


@query("""
WITH m AS (SELECT o_custkey, count(*) AS n_moves, string_agg(CAST(o_orderkey AS VARCHAR) || chr(10) || o_orderstatus || '/' || o_orderkey, chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey)
SELECT o_custkey, n_moves, left(sha256('plan' || chr(10) || body), 16) AS plan_id FROM m""")
def plan_id_hash(spark, d):
    """Plans named by their moves."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("old"), F.concat_ws("/", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("new"))
    return files.plan_id(o, "o_custkey", "o_orderkey", "old", "new", F.lit("plan"))


@query("""SELECT p_partkey, left(sha256(concat_ws('&', 'author=' || p_brand, 'title=' || p_name, 'year=' || (1990 + p_size))), 16) AS query_hash FROM part""")
def query_hash(spark, d):
    """P-S29: sorted parameters, hashed."""
    q = F.concat_ws("&", F.concat(F.lit("author="), "p_brand"), F.concat(F.lit("title="), "p_name"), F.concat(F.lit("year="), (F.col("p_size") + 1990).cast("string")))
    return table(spark, d, "part").select("p_partkey", F.left(F.sha2(q, 256), F.lit(16)).alias("query_hash"))


@query("""
WITH r AS (SELECT p_partkey AS k, p_name AS n, p_size AS s, p_type AS t, p_partkey % 4 AS m FROM part),
w AS (SELECT *, array_to_string(list_transform(string_split(n, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title, CASE WHEN m = 0 THEN 'Unknown Author' WHEN m = 1 THEN 'Lee, Ann' ELSE 'Mc Bo, Al' END AS last, CASE WHEN m < 2 THEN 1990 + s END AS y, CASE WHEN m % 2 = 0 THEN upper(t[1]) || lower(t[2:]) END AS series FROM r)
SELECT k AS p_partkey, last || '/' || coalesce(series || '/' || s || ' - ', '') || title || coalesce(' (' || y || ')', '') AS folder,
  CASE WHEN m > 1 THEN CAST(k % 2 + 1 AS VARCHAR) ELSE '' END || lpad(CAST(greatest(s, 1) AS VARCHAR), 2, '0') || ' - ' || title || '.mp3' AS file,
  upper(CASE WHEN length(n) <= 30 THEN n ELSE 'x' END) || ' ' || lpad(CAST(greatest(s, 1) AS VARCHAR), 3, '0') AS upper_case FROM w""")
def template_paths(spark, d):
    """P12, P-S17, P-S18, P-M5: templates over the names of identity, set and track; blanks leave nothing behind."""
    k = F.col("p_partkey")
    m, size = k % 4, F.col("p_size")
    author = F.when(m == 1, "Ann  Lee").when(m > 1, "mc bo, AL")
    f = {
        "title": F.when(m == 3, F.upper("p_name")), "title_guess": F.col("p_name"), "author_guess": author, "year": F.when(m < 2, size + 1990), "series": F.when(m % 2 == 0, F.col("p_type")),
        "series_index": F.when(m % 2 == 0, size), "track": size, "most_track": F.lit(50), "disc": k % 2 + 1, "disc_count": F.when(m > 1, 2).otherwise(1), "stem": F.lit("01 - x"), "track_title": F.col("p_name"),
    }
    # In steps, so that no expression is written out again within the next.
    rows = table(spark, d, "part").select("p_partkey", *[c.alias(f"{case}_{n}") for case in ("title", "upper") for n, c in naming.tokens(case, **f).items() if n not in naming.SHORT_NAMES])
    names = lambda case: {n: F.col(f"{case}_{n}") for n in set(naming.SHORT_NAMES.values()) | {"TrackTitle"}}
    t, up = ({**names(c), **{s: F.col(f"{c}_{n}") for s, n in naming.SHORT_NAMES.items()}} for c in ("title", "upper"))
    rows = rows.select("p_partkey", naming.render("{AuthorLastFirst}/{SeriesName}/{series_index} - {Title} ({Year}){Nothing}", t).alias("folder"), naming.render("{DiscPad}{TrackPad} - {track_title}", t).alias("name"), naming.render("{short_title} {Track:03}", up).alias("upper_case"))
    rows = rows.withColumn("name", naming.with_suffix(F.col("name"), F.lit(".mp3")))
    return rows.select("p_partkey", X.safe_path(F.col("folder")).alias("folder"), X.file_name(F.col("name")).alias("file"), "upper_case")


@query(r"""
WITH w AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '[\s\x{1c}-\x{1f}\x{85}\x{a0}]+', ' ', 'g')), ' ') AS w FROM documents),
c AS (SELECT doc_id, text, w, len(list_filter(range(1, least(len(w), 31) + 1), lambda k: length(array_to_string(w[1:k], ' ')) <= 30)) AS k FROM w)
SELECT doc_id, CASE WHEN length(text) <= 30 THEN text WHEN k = 0 THEN left(text, 30) ELSE array_to_string(w[1:k], ' ') END AS short_title FROM c""")
def shorten_title(spark, d):
    """P-S20, P-S24: whole words up to a length; short texts as they are."""
    return table(spark, d, "documents").select("doc_id", X.shorten(F.col("text")).alias("short_title"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN regexp_extract(p_name, '(\\S+)$', 1) || ', ' || regexp_extract(p_name, '^(.*)\\s\\S+$', 1) ELSE p_name END AS sort_name FROM part""")
def last_first(spark, d):
    """P-S19: surname first."""
    return table(spark, d, "part").select("p_partkey", X.last_first(F.col("p_name")).alias("sort_name"))


@query("""
WITH s AS (SELECT 'part' AS origin, p_partkey AS k, p_size AS size FROM part WHERE p_size > 45 UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier WHERE s_nationkey > 20)
SELECT origin, count(*) AS n, sum(size) AS bytes FROM s WHERE NOT (origin = 'supplier' AND k IN (SELECT p_partkey FROM part WHERE p_size > 45)) GROUP BY origin""")
def quarantine_union(spark, d):
    """Union of moves without those already scheduled."""
    a = table(spark, d, "part").filter("p_size > 45").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("size"))
    b = table(spark, d, "supplier").filter("s_nationkey > 20").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("size"))
    rest = b.join(a.select("k"), "k", "left_anti").select("origin", "k", "size")
    return a.unionByName(rest).groupBy("origin").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


# -- anti and semi joins -------------------------------------------------------


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def missing_cover_anti(spark, d):
    """Sets without a cover."""
    covers = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(covers, "c_custkey", "left_anti")


@query("""SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'F')""")
def forall_anti(spark, d):
    """Folders where every file qualifies."""
    o = table(spark, d, "orders")
    return o.select("o_custkey").distinct().join(o.filter("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")


@query("""SELECT o_orderkey FROM orders o WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def scheduled_anti(spark, d):
    """What another pass hasn't scheduled."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""SELECT p_partkey, p_size FROM part WHERE (p_brand) IN (SELECT p_brand FROM part GROUP BY p_brand HAVING max(p_size) <> min(p_size))""")
def sibling_discs(spark, d):
    """Items with a sibling of the same stem and another number."""
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").withColumn("several", F.max("p_size").over(w) != F.min("p_size").over(w)).filter("several").select("p_partkey", "p_size")


# -- providers -------------------------------------------------------------------


@query("""
WITH c AS (SELECT s_nationkey AS k, 0 AS prio, 'supplier' AS provider, s_name AS title, CASE WHEN s_acctbal > 5000 THEN CAST(round(s_acctbal) AS BIGINT) END AS runtime, 0.7 AS confidence, s_suppkey AS id FROM supplier
  UNION ALL SELECT c_nationkey, 1, 'customer', c_name, CAST(round(c_acctbal) AS BIGINT), 0.6, c_custkey FROM customer),
o AS (SELECT *, prio * 1000000000 + id AS ord FROM c)
SELECT k, arg_min(title, ord) FILTER (WHERE title <> '') AS title, arg_min(runtime, ord) FILTER (WHERE runtime <> 0) AS runtime,
  string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers,
  round(CASE WHEN count(DISTINCT provider) > 1 THEN least(1.0, max(confidence) + 0.07 * (count(DISTINCT provider) - 1)) ELSE max(confidence) END, 6) AS confidence
FROM o GROUP BY k""")
def provider_merge_backfill(spark, d):
    """Fields by provider priority, corroborated confidence."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(0).alias("prio"), F.lit("supplier").alias("provider"), F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 5000, F.round("s_acctbal").cast("long")).alias("runtime"), F.lit(0.7).alias("conf"), F.col("s_suppkey").alias("id"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("prio"), F.lit("customer").alias("provider"), F.col("c_name").alias("title"), F.round("c_acctbal").cast("long").alias("runtime"), F.lit(0.6).alias("conf"), F.col("c_custkey").alias("id"))
    both = s.unionByName(c).withColumn("ord", F.col("prio").cast("long") * 1000000000 + F.col("id"))
    return matching.backfill(both, "k", "ord", ["title", "runtime"], "provider", "conf").select("k", "title", "runtime", F.concat_ws(",", "providers").alias("providers"), F.round("confidence", 6).alias("confidence"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def topk_candidates(spark, d):
    """O2: the best candidates of each set."""
    return matching.top(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("""
WITH e AS (SELECT p_brand, p_partkey, p_name, (CASE WHEN p_type = 'PROMO' THEN 10 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 5 ELSE 0 END) + (CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END) AS score FROM part)
SELECT p_brand, p_partkey AS best_key, p_name AS best_name, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rn FROM e) WHERE rn = 1""")
def best_edition(spark, d):
    """The edition with most to tell, the first of equals."""
    score = F.when(F.col("p_type") == "PROMO", 10).otherwise(0) + F.when(F.col("p_size") > 25, 5).otherwise(0) + F.when(F.col("p_retailprice") > 950, 1).otherwise(0)
    e = table(spark, d, "part").withColumn("score", score)
    best = F.max(F.struct("score", (-F.col("p_partkey")).alias("k"), "p_name"))
    return e.groupBy("p_brand").agg(best.alias("b")).select("p_brand", (-F.col("b.k")).alias("best_key"), F.col("b.p_name").alias("best_name"), F.col("b.score").alias("score"))


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderkey AS v, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'P' THEN 1 WHEN o_totalprice > 400000 THEN 2 END AS rung FROM orders)
SELECT k, v, CAST(rung AS INTEGER) AS rung FROM (SELECT *, min(rung) OVER (PARTITION BY k) AS m FROM a WHERE rung IS NOT NULL) WHERE rung = m""")
def fallback_ladder(spark, d):
    """The first rung with any match wins."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    one = F.col("o_orderpriority") == "1-URGENT"
    two = ~one & (F.col("o_orderstatus") == "P")
    three = ~one & (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 400000)
    return matching.ladder([o.filter(one), o.filter(two), o.filter(three)], "k", "v").select("k", "v", "rung")


@query("""
WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS theirs FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey, o_totalprice AS ours, theirs, abs(o_totalprice - theirs) / theirs AS off FROM orders JOIN s ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN off <= 0.02 THEN 'match' WHEN off > 0.10 THEN 'mismatch' ELSE 'near' END AS verdict, round(CASE WHEN off <= 0.02 THEN 0.8 WHEN off > 0.10 THEN 0.42 ELSE 0.7 END, 6) AS checked FROM j""")
def runtime_band(spark, d):
    """J12, P-M1: lengths that agree, or don't."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("theirs"))
    j = table(spark, d, "orders").join(s, "o_orderkey").withColumn("conf", F.lit(0.7))
    return matching.runtime_check(j, "o_totalprice", "theirs", "conf").select("o_orderkey", "verdict", F.round("checked", 6).alias("checked"))


@query("""
WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, abs(a.p_size - b.p_size) AS dy FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)
SELECT a, b, CASE WHEN dy = 0 THEN 1.0 WHEN dy <= 2 THEN 0.7 WHEN dy <= 5 THEN 0.4 ELSE 0.0 END::DOUBLE AS year_score FROM p""")
def year_proximity(spark, d):
    """P-M2: years near each other, of every pair within a brand and type; a brand and type's pairs spread over many tasks."""
    return year_pairs(table(spark, d, "part"), YEAR_LOT)


def year_pairs(parts: DataFrame, lot: int) -> DataFrame:
    """(a, b, year_score) of every pair within a brand and type.

    Each one's parts are dealt into as many lots as its number asks for, and each part goes to every lot of its own.
    """
    same, each = ["p_brand", "p_type"], 4 * spread(parts.sparkSession)
    p = parts.select("p_partkey", *same, "p_size")
    p = p.join(p.groupBy(*same).agg(F.ceil(F.count("*") / lot).cast("int").alias("lots")), same)
    # Pairs are far more than what they are made from: the number of tasks isn't lowered for its size.
    a = p.withColumn("lot", F.pmod(F.xxhash64("p_partkey"), "lots").cast("int")).drop("lots").repartition(each, *same, "lot").alias("a")
    b = p.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots").repartition(each, *same, "lot").alias("b")
    # Merged, as no side need be held: neither by the driver nor by a task.
    j = a.join(b.hint("merge"), reduce(and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*same, "lot")]) & (F.col("a.p_partkey") < F.col("b.p_partkey")))
    return j.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), matching.year_score(F.col("a.p_size"), F.col("b.p_size")).alias("year_score"))


@query()
def calculate_match(spark, d):
    """P-S1 to P-S5, J3, J4, A22, UD1: each order's book against its lines' parts, as a provider's candidates.

    The book is the order's least part under another spelling; candidates have several authors, some under another name.
    """
    li, p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), table(spark, d, "part")
    own = li.groupBy("l_orderkey").agg(F.min("l_partkey").alias("own"))
    size, k = F.col("p_size"), F.col("l_orderkey") % 4
    book = own.join(p, own["own"] == p["p_partkey"]).select(
        "l_orderkey", F.concat(F.lit("The "), F.initcap("p_name"), F.when(k == 1, ": a tale").otherwise("")).alias("title"),
        F.when(k == 0, "King, Stephen").when(k == 1, "Joanne Rowling").when(k == 2, "Iain M. Banks Jr.").alias("author"), F.when(size % 2 == 0, F.col("p_brand")).alias("series"), (size + 1980).alias("year"),
    )
    book = matching.book_keys(book).select("l_orderkey", "title_key", "author_key", "series_key", "year")
    names = F.array(F.lit("Ann Lee"), F.when(size % 3 == 0, "Richard Bachman").when(size % 3 == 1, "Robert Galbraith").otherwise("Iain Banks"))
    candidate = p.select("p_partkey", F.col("p_name").alias("c_title"), names.alias("c_authors"), F.col("p_brand").alias("c_series"), (size + 1981).alias("c_year"))
    candidate = matching.candidate_keys(candidate).select(F.col("p_partkey").alias("l_partkey"), "c_title_key", "c_author_keys", "c_series_key", "c_year")
    # A part stands in many orders: its names are made comparable once, not in each of them.
    scored = matching.scored(li.join(candidate, "l_partkey").join(book, "l_orderkey"))
    parts = [F.round(c, 6).alias(c) for c in ("title_score", "author_score", "series_score", "year_score", "confidence")]
    return scored.select("l_orderkey", "l_partkey", *parts, "level", F.concat_ws(",", "reasons").alias("reasons"))


@query("""
SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN p_type ELSE '' END, ''), p_name) AS fill_missing, coalesce(p_name, '') AS overwritten,
  CASE WHEN p_retailprice / 2000 > 0.85 THEN 'Accept' WHEN p_retailprice > 950 THEN 'Review' ELSE 'Manual' END AS shown FROM part""")
def tag_write_policy(spark, d):
    """Which tag survives, and how a match is shown."""
    p = table(spark, d, "part")
    old = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("")
    shown = F.when(F.col("p_retailprice") / 2000 > matching.HIGH, "Accept").when(F.col("p_retailprice") > 950, "Review").otherwise("Manual")
    return p.select("p_partkey", matching.write_policy(old, F.col("p_name"), "fill_missing").alias("fill_missing"), matching.write_policy(old, F.col("p_name"), "overwrite").alias("overwritten"), shown.alias("shown"))


@query("""
SELECT user_id AS provider, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean_value, count(*) < 5 OR count(*) FILTER (WHERE event_type <> 'error') * 1.0 / count(*) > 0.5 AS healthy FROM events GROUP BY user_id""")
def provider_stats(spark, d):
    """Counters, mean and health of a provider."""
    ok = F.count_if(F.col("event_type") != "error")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("provider")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"), ((F.count("*") < 5) | (ok / F.count("*") > 0.5)).alias("healthy"))


# -- progress, cache, history -----------------------------------------------------


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS stamp, event_id, value, event_type FROM events),
a AS (SELECT user_id, max(stamp) AS stamp, arg_max(value, struct_pack(a := stamp, b := -event_id)) AS value FROM e WHERE event_id % 2 = 0 GROUP BY user_id),
b AS (SELECT user_id, max(stamp) AS stamp, arg_max(value, struct_pack(a := stamp, b := -event_id)) AS value FROM e WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.stamp IS NOT NULL AND (a.stamp IS NULL OR b.stamp > a.stamp) THEN b.stamp ELSE a.stamp END AS stamp,
  CASE WHEN b.stamp IS NOT NULL AND (a.stamp IS NULL OR b.stamp > a.stamp) THEN b.value ELSE a.value END AS value, b.stamp IS NOT NULL AND (a.stamp IS NULL OR b.stamp > a.stamp) AS pulled
FROM a FULL JOIN b ON a.user_id = b.user_id""")
def lww_progress(spark, d):
    """J8, ST2: the server's row wins only if strictly newer."""
    e = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("stamp"), "event_id", "value")
    ours, theirs = (progress.latest(e.filter(F.col("event_id") % 2 == r), "user_id", "stamp", "event_id", ["value"]) for r in (0, 1))
    return progress.merge(ours, theirs, "user_id", "stamp", ["value"])


@query("""
WITH c AS (SELECT event_type AS provider, epoch_us(ts) AS stamp, CASE WHEN value > 1 THEN epoch_us(ts) + 43200000000 END AS expires, length(props) AS n FROM events), m AS (SELECT max(stamp) AS now FROM c)
SELECT provider, count(*) AS entries, count(*) FILTER (WHERE expires IS NOT NULL AND now > expires) AS expired, sum(n) AS bytes FROM c, m GROUP BY provider""")
def ttl_cache_stats(spark, d):
    """F16, A21, J9, ST4: entries, expired ones, size; now is the newest entry."""
    c = table(spark, d, "events").select(F.col("event_type").alias("provider"), F.unix_micros("ts").alias("at"), F.length("props").alias("n"), "value")
    c = c.withColumn("expires", F.when(F.col("value") > 1, F.col("at") + 43200000000))
    now = F.broadcast(c.agg(F.max("at").alias("now")))  # one row
    return c.crossJoin(now).groupBy("provider").agg(F.count("*").alias("entries"), F.count_if(F.col("now") > F.col("expires")).alias("expired"), F.sum("n").alias("bytes"))


@query("""
WITH m AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT event_id, CASE WHEN event_type = 'purchase' THEN event_type WHEN value > 20 THEN 'dedupe' ELSE 'rename' END AS kind, event_type = 'signup' AS undone
FROM events, m WHERE event_type = 'signup' OR epoch_us(ts) >= now - CAST(2 AS BIGINT) * 86400000000""")
def history_log(spark, d):
    """Recent live entries, and undone ones always."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros("ts"))
    now = F.broadcast(e.agg(F.max("at").alias("now")))  # one row
    kind = F.when(F.col("event_type") == "purchase", F.col("event_type")).when(F.col("value") > 20, "dedupe").otherwise("rename")
    undone = F.col("event_type") == "signup"
    return e.crossJoin(now).filter(undone | (F.col("at") >= F.col("now") - 2 * 86400000000)).select("event_id", kind.alias("kind"), undone.alias("undone"))


@query("""SELECT event_id, value, value >= 20 AS finished, NOT (value >= 20) AS unsynced FROM events WHERE event_type = 'view'""")
def progress_updates(spark, d):
    """ST5, S24: local updates, finished from a threshold on."""
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.select("event_id", "value", (F.col("value") >= 20).alias("finished"), (F.col("value") < 20).alias("unsynced"))


@query("""SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50 OFFSET 100""")
def library_page(spark, d):
    """One page of a listing."""
    return table(spark, d, "events").orderBy("event_id").offset(100).limit(50).select("event_id", "event_type")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""".replace("time_bucket(INTERVAL '1 hour', ts)", "epoch_us(date_trunc('hour', ts))"))
def hourly_events(spark, d):
    """Listening counts by hour."""
    e = table(spark, d, "events")
    return e.groupBy(F.unix_micros(F.date_trunc("hour", "ts")).alias("hour"), "event_type").agg(F.count("*").alias("n"))


# -- health ------------------------------------------------------------------------


@query("""
WITH i AS (SELECT 'short' AS category FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT 'untagged' FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' UNION ALL SELECT 'empty' FROM orders WHERE o_totalprice < 5000)
SELECT coalesce(category, 'total') AS category, count(*) AS n FROM i GROUP BY ROLLUP (category)""")
def health_summary(spark, d):
    """Issues by category, and in all."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = [li.filter("l_quantity < 5").select(F.lit("short").alias("category")), li.filter("l_returnflag = 'N' AND l_linestatus = 'O'").select(F.lit("untagged").alias("category")), o.filter("o_totalprice < 5000").select(F.lit("empty").alias("category"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).rollup("category").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("total")).alias("category"), "n")


@query("""
SELECT count(*) AS n_tracks, count(DISTINCT l_orderkey) AS n_sets, count(*) FILTER (WHERE l_quantity < 5) AS n_short, count(*) FILTER (WHERE l_returnflag IS NULL) AS n_untagged, count(*) FILTER (WHERE l_discount = 0) AS n_plain FROM lineitem""")
def doctor_counters(spark, d):
    """All counters in one pass."""
    c = F.count_if
    return table(spark, d, "lineitem").agg(F.count("*").alias("n_tracks"), F.count_distinct("l_orderkey").alias("n_sets"), c(F.col("l_quantity") < 5).alias("n_short"), c(F.col("l_returnflag").isNull()).alias("n_untagged"), c(F.col("l_discount") == 0).alias("n_plain"))


# -- scalar functions ---------------------------------------------------------------


FOLD = "regexp_replace(translate({}, 'áàâäãåéèêëíìîïóòôöõúùûüçñýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ', 'aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY'), '[^\\x00-\\x7F]', '', 'g')"


BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"""
WITH s AS (SELECT doc_id, chr(9) || CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'The' || chr(160) || text ELSE text || ', ' || 'Der' END || ' ' AS text FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^{BLANK}+|{BLANK}+$', '', 'g'), ',{BLANK}*(?:the|a|an|el|la|le|der|die)$', '') AS t FROM s),
b AS (SELECT doc_id, regexp_replace(t, '^(?:the|a|an|el|la|le|der|die){BLANK}+', '') AS t FROM a),
c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[^\p{{L}}\p{{N}}_{BLANK[1:-1]}-]', '', 'g'), '{BLANK}+', ' ', 'g')) AS t FROM b)
SELECT doc_id, sha256({FOLD.format('t')}) AS title_key, length({FOLD.format('t')}) AS n FROM c""")
def title_normalize(spark, d):
    """P-S1, UD5: keys of whole texts as titles, with articles at either end and blanks of several kinds."""
    k = F.col("doc_id") % 4
    title = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("The\xa0"), "text")).otherwise(F.concat("text", F.lit(", Der")))
    key = X.normalize_title(F.concat(F.lit("\t"), title, F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", F.sha2(key, 256).alias("title_key"), F.length(key).cast("long").alias("n"))


AUTHORS = """a AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Ñandú, ' || c_mktsegment || ' Jr.' WHEN 1 THEN c_mktsegment || ' Müller III' WHEN 2 THEN ' Sr. Jr.' WHEN 3 THEN '' WHEN 4 THEN 'A, B, ' || c_nationkey WHEN 5 THEN chr(9) || c_mktsegment || ' iv sr.' ELSE NULL END AS t FROM customer)"""


@query(f"""
WITH {AUTHORS}, l AS (SELECT c_custkey, regexp_replace(lower(t), '^[\\s]+|[\\s]+$', '', 'g') AS t FROM a),
s1 AS (SELECT c_custkey, trim(CASE WHEN ends_with(t, ' jr.') THEN left(t, length(t) - 4) ELSE t END) AS t FROM l), s2 AS (SELECT c_custkey, trim(CASE WHEN ends_with(t, ' sr.') THEN left(t, length(t) - 4) ELSE t END) AS t FROM s1),
s3 AS (SELECT c_custkey, trim(CASE WHEN ends_with(t, ' ii') THEN left(t, length(t) - 3) ELSE t END) AS t FROM s2), s4 AS (SELECT c_custkey, trim(CASE WHEN ends_with(t, ' iii') THEN left(t, length(t) - 4) ELSE t END) AS t FROM s3),
s5 AS (SELECT c_custkey, strip_accents(trim(CASE WHEN ends_with(t, ' iv') THEN left(t, length(t) - 3) ELSE t END)) AS t FROM s4)
SELECT c_custkey, CASE WHEN contains(t, ',') THEN trim(substr(t, strpos(t, ',') + 1)) || ' ' || trim(left(t, strpos(t, ',') - 1)) ELSE t END AS author_key FROM s5""")
def author_normalize(spark, d):
    """P-S2: one key for "Last, First Jr." and "First Last"; suffixes in their order, accents, several commas, blanks."""
    k, seg = F.col("c_custkey") % 7, F.col("c_mktsegment")
    t = F.when(k == 0, F.concat(F.lit("Ñandú, "), seg, F.lit(" Jr."))).when(k == 1, F.concat(seg, F.lit(" Müller III"))).when(k == 2, " Sr. Jr.").when(k == 3, "").when(k == 4, F.concat(F.lit("A, B, "), F.col("c_nationkey").cast("string"))).when(k == 5, F.concat(F.lit("\t"), seg, F.lit(" iv sr.")))
    return table(spark, d, "customer").select("c_custkey", X.normalize_author(t).alias("author_key"))


TITLES = """t AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name || ' Book ' || p_size WHEN 1 THEN p_name || ' VOL ' || p_size || ' part 3' WHEN 2 THEN p_name || '  #' || p_size WHEN 3 THEN p_name || ' part ' || p_size || ' and part 9' WHEN 4 THEN p_name || ' volume  ' || p_size || 'x'
  WHEN 5 THEN 'book ' || p_size WHEN 6 THEN p_name || ' #' || p_size || ' book 2' WHEN 7 THEN p_name || ' part' || p_size ELSE NULL END AS t FROM part)"""


@query(f"""
WITH {TITLES}, m AS (SELECT p_partkey, regexp_extract(t, '(?i)(.+?)\\s+(?:book|vol(?:ume)?)\\s+(\\d+)', ['a', 'b']) AS x, regexp_extract(t, '(.+?)\\s+#(\\d+)', ['a', 'b']) AS y, regexp_extract(t, '(?i)(.+?)\\s+part\\s+(\\d+)', ['a', 'b']) AS z FROM t)
SELECT p_partkey, trim(CASE WHEN x.b <> '' THEN x.a WHEN y.b <> '' THEN y.a WHEN z.b <> '' THEN z.a END) AS series, CASE WHEN x.b <> '' THEN x.b WHEN y.b <> '' THEN y.b WHEN z.b <> '' THEN z.b END AS volume,
  CASE WHEN x.b <> '' THEN 0.95 WHEN y.b <> '' THEN 0.90 WHEN z.b <> '' THEN 0.85 END::DOUBLE AS confidence FROM m""")
def series_extract(spark, d):
    """P-S6, P-S10: series and volume in a title, by the first pattern that applies; several shapes at once, none, and no title."""
    k, size = F.col("p_partkey") % 9, F.col("p_size").cast("string")
    shapes = [(" Book ", ""), (" VOL ", " part 3"), ("  #", ""), (" part ", " and part 9"), (" volume  ", "x"), None, (" #", " book 2"), (" part", "")]
    title = F.when(k == 5, F.concat(F.lit("book "), size))
    for i, s in enumerate(shapes):
        title = title.when(k == i, F.concat("p_name", F.lit(s[0]), size, F.lit(s[1]))) if s else title
    s = X.series_of(title)
    return table(spark, d, "part").select("p_partkey", s["series"].alias("series"), s["volume"].alias("volume"), s["confidence"].alias("confidence"))


@query("""
SELECT o_orderkey, regexp_matches(replace(lpad(CAST(o_orderkey * 7919 AS VARCHAR), 10, '0'), '-', ''), '^(?:\\d{9}[\\dXx]|\\d{13})$') AS isbn_ok, regexp_matches('B0' || lpad(CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 8 ELSE 7 END, 'A'), '^(?i)B0[A-Z0-9]{8}$') AS asin_ok FROM orders""")
def id_validate(spark, d):
    """F7, P-S16, P-S28: identifiers that can be ones."""
    o = table(spark, d, "orders")
    isbn = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 10, "0")
    asin = F.concat(F.lit("B0"), F.when(F.col("o_orderkey") % 2 == 0, F.lpad(F.col("o_custkey").cast("string"), 8, "A")).otherwise(F.lpad(F.col("o_custkey").cast("string"), 7, "A")))
    return o.select("o_orderkey", X.valid_isbn(isbn).alias("isbn_ok"), X.valid_asin(asin).alias("asin_ok"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'published ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'no 12345 or 1850 but ' || year(o_orderdate) || '.' WHEN 2 THEN 'x' || year(o_orderdate) || ' 2099' WHEN 3 THEN '' WHEN 4 THEN strftime(o_orderdate, '%d%m%Y') END AS t FROM orders)
SELECT o_orderkey, CAST(nullif(regexp_extract(t, '\\b((?:19|20)[0-9][0-9])\\b', 1), '') AS INTEGER) AS year_found, split_part(t, '-', 1) AS year_prefix FROM t""")
def year_extract(spark, d):
    """P-D1, P-D2: the first year in free text that stands alone, and what is before a dash."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 6
    year = F.date_format("o_orderdate", "yyyy")
    text = F.when(k == 0, F.concat(F.lit("published "), F.date_format("o_orderdate", "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("no 12345 or 1850 but "), year, F.lit("."))).when(k == 2, F.concat(F.lit("x"), year, F.lit(" 2099"))).when(k == 3, "").when(k == 4, F.date_format("o_orderdate", "ddMMyyyy"))
    return o.select("o_orderkey", X.year_in(text).alias("year_found"), F.split_part(text, F.lit("-"), F.lit(1)).alias("year_prefix"))


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size || ' hrs and ' || p_size % 60 || ' mins' WHEN 1 THEN p_size || 'HR' WHEN 2 THEN p_size || ' minutes' WHEN 3 THEN p_size || ' hours' WHEN 4 THEN '' WHEN 5 THEN 'Length: ' || p_size || ' min, 2 hr' WHEN 6 THEN '0 hrs' END AS t FROM part),
n AS (SELECT p_partkey, coalesce(CAST(nullif(regexp_extract(t, '(?i)(\\d+)\\s*hr', 1), '') AS INTEGER), 0) AS h, coalesce(CAST(nullif(regexp_extract(t, '(?i)(\\d+)\\s*min', 1), '') AS INTEGER), 0) AS m FROM t)
SELECT p_partkey, nullif(h * 60 + m, 0) AS minutes FROM n""")
def runtime_parse(spark, d):
    """P-D6: "4 hrs and 7 mins", in any order and case; "hours" aren't read, nothing is null."""
    k, size = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(size, F.lit(" hrs and "), (F.col("p_size") % 60).cast("string"), F.lit(" mins"))).when(k == 1, F.concat(size, F.lit("HR"))).when(k == 2, F.concat(size, F.lit(" minutes"))).when(k == 3, F.concat(size, F.lit(" hours")))
    text = text.when(k == 4, "").when(k == 5, F.concat(F.lit("Length: "), size, F.lit(" min, 2 hr"))).when(k == 6, "0 hrs")
    return table(spark, d, "part").select("p_partkey", X.runtime_minutes(text).alias("minutes"))


def _sql_int(c, *patterns):
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract({c}, '{p}', 1), '') AS INTEGER)" for p in patterns) + ")"


#: Names in all the ways that a track, a disc and a folder are called; {n} is a number, {b} and {t} are names.
_STEMS = ("{n} - Chapter", "Track {n}", "chapter{n} of 9", "Part {n}", "x {n}. y", "no number", "1234", "")
_DISCS = ("Disc {n}", "cd{n}", "BOOK {n}", "vol. {n}", "Disc {n} b", "Disc-{n}", "disc", "volume {n}")
_NAMES = ("{b} - {t} (Unabridged) [64k]", "[x] {b} – {t}", "{t}", "{b}-{t} - more", " - {t}", "{b} — ", "({b}) {t} - [y]{b}", "")


def _sql_shape(shapes, shift):
    one = lambda s: " || ".join(["''", *[{"n": "p_size", "b": "p_brand", "t": "p_name"}.get(x, "'" + x + "'") for x in re.split(r"[{}]", s) if x]])
    return f"CASE (p_partkey + {shift}) % {len(shapes)} " + " ".join(f"WHEN {i} THEN {one(s)}" for i, s in enumerate(shapes)) + " END"


def _shape(shapes, shift):
    cols = {"n": F.col("p_size").cast("string"), "b": F.col("p_brand"), "t": F.col("p_name")}
    found = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        text = F.concat(F.lit(""), *[cols.get(x, F.lit(x)) for x in re.split(r"[{}]", s) if x])
        found = F.when((F.col("p_partkey") + shift) % len(shapes) == i, text).otherwise(found)
    return found


@query(rf"""
WITH s AS (SELECT p_partkey, {_sql_shape(_STEMS, 0)} AS stem, {_sql_shape(_DISCS, 3)} AS folder, trim(regexp_replace(regexp_replace({_sql_shape(_NAMES, 5)}, '\s*\[.*?\]\s*', '', 'g'), '\s*\(.*?\)\s*', '', 'g')) AS name FROM part)
SELECT p_partkey, {_sql_int("stem", *X.TRACK_PATTERNS)} AS track_no, CAST({_sql_int("folder", X.DISC_PATTERN)} AS BIGINT) AS disc_no,
  nullif(trim(regexp_extract(name, '^(.+?)\s*[-–—]\s*(.+)$', 1)), '') AS author, nullif(trim(regexp_extract(name, '^(.+?)\s*[-–—]\s*(.+)$', 2)), '') AS title FROM s""")
def name_guess(spark, d):
    """P-S7, P-S8, P-S11, P-S12, P-S14: numbers and names in file and folder names of many shapes."""
    name = X.clean_noise(_shape(_NAMES, 5))
    return table(spark, d, "part").select("p_partkey", X.first_int(_shape(_STEMS, 0), *X.TRACK_PATTERNS).alias("track_no"), X.first_int(_shape(_DISCS, 3), X.DISC_PATTERN).cast("long").alias("disc_no"), X.split_dash(name, 1).alias("author"), X.split_dash(name, 2).alias("title"))


_PEOPLE = ("{b}", "AB {n}", "{n}", "{n} 4 b", "Bo", "Ann Lee {n}", "", "Q", "ABCDE 1", "x{n}{n}{n}", "  Jo ", "Ann-Marie")


@query(rf"""
WITH n AS (SELECT p_partkey, trim({_sql_shape(_PEOPLE, 0)}) AS t FROM part)
SELECT p_partkey, t <> '' AND (regexp_matches(t, '{X.CODE_NAME}') OR length(regexp_replace(t, '[^0-9]', '', 'g')) * 2 > length(regexp_replace(t, '\s', '', 'g')) OR (NOT regexp_matches(t, '\s') AND length(t) <= 3)) AS implausible FROM n""")
def implausible_authors(spark, d):
    """What can't be a person's name: codes, mostly digits, short single words."""
    return table(spark, d, "part").select("p_partkey", X.implausible_person(_shape(_PEOPLE, 0)).alias("implausible"))


@query("""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&[A-Za-z]+;|&#\\d+;', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS n_links FROM pages""")
def html_fields(spark, d):
    """P-H1, P-S27, P8, S19, S21: fields of a product page."""
    p = table(spark, d, "pages")
    title = X.blank_to_null(sidecars.html_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return p.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), title.alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("long").alias("n_links"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_coerce(spark, d):
    """P-J1, P-J2, P-S31, S10: values of loosely typed JSON."""
    e = table(spark, d, "events")
    return e.select("event_id", sidecars.loose_text(F.col("props"), "$.k").alias("k"), sidecars.loose_text(F.col("props"), "$.missing").alias("missing"))


_NFO = (
    "Title: draft\nASIN=@p\nno pair here\ntitle : @s", "TITLE = x : @s\r\nAsin:@p\r\n", "  title :\nasin= @p = y", "1title: no\nTitle:@s\n\nreal asin: @p", "no pairs\n= nothing\n: none", "title=@s\ntitle:\nasin :@p\nASIN:  ", "",
)


def _sql_lines(s):
    return "'" + s.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '").replace("@p", "' || o_orderpriority || '").replace("@s", "' || o_orderstatus || '") + "'"


@query(rf"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % {len(_NFO)} {' '.join(f"WHEN {i} THEN {_sql_lines(s)}" for i, s in enumerate(_NFO))} END AS t FROM orders),
l AS (SELECT o_orderkey, list_filter(string_split_regex(t, '\r?\n'), lambda x: regexp_matches(x, '^\s*[A-Za-z][\w ]*\s*[:=]')) AS lines FROM t),
p AS (SELECT o_orderkey, list_transform(lines, lambda x: lower(trim(regexp_extract(x, '^\s*([^:=]+)[:=]', 1)))) AS k, list_transform(lines, lambda x: trim(regexp_extract(x, '^[^:=]+[:=](.*)$', 1))) AS v FROM l)
SELECT o_orderkey, v[list_max(list_filter(range(1, len(k) + 1), lambda i: k[i] = 'title'))] AS title, v[list_max(list_filter(range(1, len(k) + 1), lambda i: k[i] = 'asin'))] AS asin FROM p""")
def nfo_fields(spark, d):
    """Key and value lines of several shapes, the last of a key wins."""
    text = F.lit(None).cast("string")
    for i, s in enumerate(_NFO):
        parts = [{"p": F.col("o_orderpriority"), "s": F.col("o_orderstatus")}.get(x[1:]) if x in ("@p", "@s") else F.lit(x) for x in re.split("(@[ps])", s) if x]
        text = F.when(F.col("o_orderkey") % len(_NFO) == i, F.concat(F.lit(""), *parts)).otherwise(text)
    m = sidecars.key_values(F.col("t"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", F.try_element_at(m, F.lit("title")).alias("title"), F.try_element_at(m, F.lit("asin")).alias("asin"))


@query("""SELECT p_partkey, '{"title":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"series":"' || p_brand || '"' ELSE '' END || '}' AS doc FROM part""")
def sidecar_json(spark, d):
    """K1, K5: documents that leave out what is blank."""
    s = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("series"))
    return table(spark, d, "part").select("p_partkey", F.to_json(s, {"ignoreNullFields": "true"}).alias("doc"))


@query("""
SELECT conv_id, string_agg('[CHAPTER]' || chr(10) || 'START=' || turn * 1000 || chr(10) || 'title=' || role, chr(10) ORDER BY turn) AS doc FROM conversations GROUP BY conv_id""")
def ffmetadata(spark, d):
    """K6: chapter documents."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    parts = F.transform(rows, lambda r: F.concat(F.lit("[CHAPTER]\nSTART="), (r["turn"] * 1000).cast("string"), F.lit("\ntitle="), r["role"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, "\n").alias("doc"))


@query("""SELECT doc_id, sha256(text) AS full_hash, sha256(left(text, 64) || right(text, 64)) AS probe_hash FROM documents""")
def content_hashes(spark, d):
    """P-B1: full hashes, and of head and tail."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("full_hash"), F.sha2(F.concat(F.left(t, F.lit(64)), F.right(t, F.lit(64))).cast("binary"), 256).alias("probe_hash"))


@query("""SELECT page_id, CASE WHEN contains(left(html, 64), 'DOCTYPE') THEN 'signed' WHEN regexp_matches(url, '\\.aax$') THEN 'suffix' ELSE 'none' END AS kind FROM pages""")
def protection_sniff(spark, d):
    """S29, P-B2: kind by suffix, else by the first 64 bytes."""
    head = F.substring(F.col("html").cast("binary"), 1, 64)
    return table(spark, d, "pages").select("page_id", F.when(F.contains(head, F.lit("DOCTYPE").cast("binary")), "signed").when(F.col("url").rlike(r"\.aax$"), "suffix").otherwise("none").alias("kind"))
