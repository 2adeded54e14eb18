"""Queries that go from listings to sets; order lines stand for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import scanning
from ..sources.tables import table
from .queries import query

FILES = """f AS (SELECT DISTINCT concat_ws('/', 'Ann Lee - Work ' || (l_orderkey % 400),
    CASE l_partkey % 3 WHEN 0 THEN 'CD' || l_linenumber WHEN 1 THEN 'Story Disc ' || (l_linenumber % 3) ELSE NULL END,
    lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ' ' || l_suppkey || CASE l_suppkey % 4 WHEN 0 THEN '.m4b' WHEN 1 THEN '.txt' ELSE '.mp3' END) AS path,
  CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN 'Tale Disc ' || l_linenumber ELSE 'Other' END AS album, CAST(l_linenumber * 700 AS DOUBLE) AS duration FROM lineitem)"""


def _files(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    middle = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("CD"), s("l_linenumber"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("Story Disc "), (F.col("l_linenumber") % 3).cast("string")))
    kind = F.when(F.col("l_suppkey") % 4 == 0, ".m4b").when(F.col("l_suppkey") % 4 == 1, ".txt").otherwise(".mp3")
    path = F.concat_ws("/", F.concat(F.lit("Ann Lee - Work "), (F.col("l_orderkey") % 400).cast("string")), middle, F.concat(F.lpad(s("l_linenumber"), 2, "0"), F.lit(" "), s("l_suppkey"), kind))
    album = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Tale Disc "), s("l_linenumber"))).when(F.col("l_returnflag") != "R", "Other")
    return li.select(path.alias("path"), album.alias("album"), (F.col("l_linenumber") * 700).cast("double").alias("duration")).distinct()


@query(f"""
WITH {FILES} SELECT path, regexp_extract(path, '\\.([^.]+)$', 1) AS suffix, count(*) AS n FROM f WHERE NOT ends_with(path, '.txt') AND len(string_split(path, '/')) <= 2 GROUP BY path""")
def scan_audio(spark, d):
    """Audio files to a depth, outside hidden and quarantined folders."""
    found = scanning.outside_quarantine(scanning.audio_files(_files(spark, d), "path", max_depth=1), "path")
    return found.groupBy("path").agg(F.count("*").alias("n")).withColumn("suffix", scanning.suffix_of(F.col("path")))


GROUPED = f"""{FILES}, a AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM f WHERE NOT ends_with(path, '.txt')),
d AS (SELECT DISTINCT folder, regexp_extract(folder, '^(.*)/[^/]*$', 1) AS up, nullif(regexp_extract(folder, '/Story Disc (\\d)$', 1), '') AS num, regexp_matches(folder, '/CD\\d$') AS cd FROM a),
q AS (SELECT *, cd OR (num IS NOT NULL AND count(DISTINCT num) OVER (PARTITION BY up) > 1) AS disc FROM d),
r AS (SELECT a.*, CASE WHEN q.disc THEN q.up ELSE a.folder END AS root, q.disc, CASE WHEN album LIKE 'Tale%' THEN 'tale' ELSE lower(album) END AS k FROM a JOIN q USING (folder)),
o AS (SELECT root, bool_or(disc) AS collapsed, min(k) AS low, max(k) AS high FROM r GROUP BY root),
g AS (SELECT r.*, o.collapsed, CASE WHEN o.collapsed THEN 'all' WHEN k IS NOT NULL THEN 'album:' || k WHEN ends_with(path, '.m4b') OR duration >= 3600 THEN 'file:' || path WHEN low = high THEN 'album:' || low ELSE 'rest' END AS label,
  coalesce(CASE WHEN album LIKE 'Tale%' THEN CAST(regexp_extract(album, '(\\d+)$', 1) AS INTEGER) END, CAST(nullif(regexp_extract(path, '(?:CD|Disc )(\\d+)/', 1), '') AS INTEGER), 1) AS disc_no FROM r JOIN o USING (root))"""


@query(f"""
WITH {GROUPED}, s AS (SELECT root, label, count(*) AS n_tracks, count(DISTINCT disc_no) AS n_discs, sum(duration) AS duration, min(path) AS p FROM g GROUP BY root, label)
SELECT root, label, n_tracks, n_discs, duration, CASE WHEN count(*) OVER (PARTITION BY root) > 1 THEN CAST(row_number() OVER (PARTITION BY root ORDER BY p, label) AS INTEGER) END AS synthetic FROM s""")
def scan_sets(spark, d):
    """S3, A1, A2, J1, F11, F25, P10, P-S12, P-S13, W12: files to roots, albums and sets."""
    f = scanning.audio_files(_files(spark, d), "path")
    folders = f.select(scanning.parent_of(F.col("path")).alias("folder"))
    g = scanning.grouped(f, folders).withColumn("disc", scanning.disc_number(F.col("path"), F.lit(None).cast("string"), F.col("album"), F.col("above")))
    return scanning.sets(g).select("root", "label", "n_tracks", "n_discs", "duration", "synthetic")


@query("""
WITH k AS (SELECT *, 'B0' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code FROM part)
SELECT p_partkey, nullif(trim(p_name), '') AS title, CASE p_size % 4 WHEN 1 THEN code WHEN 3 THEN code WHEN 2 THEN code END AS asin, CASE WHEN p_size % 3 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '9') END AS isbn,
  CASE WHEN p_size % 2 = 0 THEN 'Reader ' || p_brand ELSE p_type END AS narrator, p_brand AS albumartist, CAST(1990 + p_size AS VARCHAR) AS date,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN 999 WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END AS INTEGER) AS track_index, CAST(CASE WHEN p_partkey % 11 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END AS INTEGER) AS disc_index,
  CASE WHEN p_partkey % 11 = 0 THEN 'error' ELSE 'valid' END AS status FROM k
""")
def track_rows(spark, d):
    """S4, S5, S6, P-S14 to P-S16, P-S30: tags by ordered keys, codes in free text and in links; unusable files are error rows."""
    p = table(spark, d, "part")
    s = lambda c: F.col(c).cast("string")
    code = F.concat(F.lit("b0"), F.lpad(s("p_partkey"), 8, "0"))
    size = F.col("p_size")
    tags = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("TIT2", "\xa9nam", "TITLE", "TXXX:ASIN", "TXXX:AUDIBLE_ASIN", "CDEK", "WXXX:shop", "TXXX:ISBN", "ISBN", "TCOM", "\xa9nrt", "TPE2", "\xa9day", "TRCK", "disk", "disc")]),
        F.array(
            F.lit(" \t "), F.lit("later"), F.col("p_name"), F.lit("bad"), F.when(size % 4 == 1, F.upper(code)), F.when(size % 4 == 3, F.concat(F.lit("shop id "), code, F.lit(" ok"))),
            F.when(size % 4 == 2, F.concat(F.lit("https://shop/pd/"), code, F.lit("?x=1"))), F.lit("12-34"), F.when(size % 3 == 0, F.concat(F.lit(" 999-"), F.substring(F.lpad(s("p_partkey"), 13, "9"), 4, 10))),
            F.col("p_type"), F.when(size % 2 == 0, F.concat(F.lit("Reader "), "p_brand")), F.col("p_brand"), (size + 1990).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(s("p_size"), F.lit("/90"))), F.when(F.col("p_partkey") % 5 == 0, "2 of 3"), F.lit("9"),
        ),
    )
    f = p.select("p_partkey", F.lit("Lib/Disc 3/07 - x.mp3").alias("path"), tags.alias("tags"), F.when(F.col("p_partkey") % 11 == 0, -1.0).otherwise(60.0).alias("duration"))
    return scanning.track_rows(f).select("p_partkey", "title", "asin", "isbn", "narrator", "albumartist", "date", "track_index", "disc_index", "status")


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Night Train' WHEN 1 THEN 'Night Train' WHEN 2 THEN 'Saga Book ' || c_nationkey WHEN 3 THEN 'The Train' ELSE 'Night Train' END AS title,
  CASE c_custkey % 5 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'Ann Lee' ELSE NULL END AS author,
  CASE c_custkey % 5 WHEN 2 THEN 'Saga' END AS series, CASE c_custkey % 5 WHEN 2 THEN CAST(c_nationkey AS VARCHAR) END AS volume, CASE WHEN c_custkey % 2 = 0 THEN 'Lee, Ann' END AS up_author FROM customer""")
def name_sides(spark, d):
    """P11, P-S9, F8, F9, F10: title and author in names; discs say which side is a person."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "Ann Lee - Night Train [64k]").when(k == 1, "AB12 - Night Train").when(k == 2, F.concat(F.lit("Saga Book "), F.col("c_nationkey").cast("string"))).when(k == 3, "The Train - Ann Lee").otherwise("Night Train (2001)")
    g = X.name_guess(name, k == 3)
    up = X.parent_author(F.when(F.col("c_custkey") % 2 == 0, "Lee, Ann").otherwise("Library 1"))
    return c.select("c_custkey", g["title"].alias("title"), g["author"].alias("author"), g["series"].alias("series"), g["volume"].alias("volume"), up.alias("up_author"))


@query("""
SELECT o_custkey, count(*) AS n_tracks, CASE WHEN count(*) = 1 THEN 'x' || min(o_orderkey) ELSE 'Work ' || o_custkey END AS title, 'Ann Lee' AS author FROM orders GROUP BY o_custkey""")
def set_guesses(spark, d):
    """P10, P11, P-S9: a set's guesses from its folder, or from its only file."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_tracks"), F.min("o_orderkey").alias("k"))
    root = F.concat(F.lit("Lib/Ann Lee - Work "), F.col("o_custkey").cast("string"))
    none = F.lit(None).cast("string")
    v = scanning.guesses(root, F.lit(False), F.col("n_tracks"), none, none, F.concat(F.lit("x"), F.col("k").cast("string")))
    return g.select("o_custkey", "n_tracks", v["title"].alias("title"), v["author"].alias("author"))


@query("""
WITH s AS (SELECT c_nationkey AS folder, CASE c_custkey % 4 WHEN 0 THEN 'book.nfo' WHEN 1 THEN 'info.json' WHEN 2 THEN 'a' || c_custkey || '.nfo' ELSE 'cover.jpg' END AS name, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS body FROM customer),
r AS (SELECT *, CASE name WHEN 'info.json' THEN 3 WHEN 'book.nfo' THEN 6 ELSE 101 END AS rank FROM s WHERE body IS NOT NULL AND name <> 'cover.jpg')
SELECT folder, name, body FROM r QUALIFY row_number() OVER (PARTITION BY folder ORDER BY rank, name, body) = 1""")
def local_sidecar(spark, d):
    """The folder's first sidecar that parses, by preference."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "book.nfo").when(k % 4 == 1, "info.json").when(k % 4 == 2, F.concat(F.lit("a"), k.cast("string"), F.lit(".nfo"))).otherwise("cover.jpg")
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("folder"), name.alias("name"), F.when(k % 3 > 0, F.col("c_name")).alias("body"))
    return scanning.best_sidecar(s, "folder", "name", "body")


@query("""
SELECT o_custkey, arg_min('Reader ' || o_orderkey, (o_orderpriority, o_orderkey)) AS narrator FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def nfo_narrator(spark, d):
    """The first line that names who reads."""
    o = table(spark, d, "orders")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", " Read by: ").when(F.col("o_orderstatus") == "O", "narrator = ").otherwise("written by: "), F.lit("Reader "), F.col("o_orderkey").cast("string"))
    return scanning.narrator_of(o.withColumn("line", line), "o_custkey", "o_orderpriority", "o_orderkey", "line")


@query("""
SELECT p_partkey, p_name || ' and more' AS title, nullif(trim(regexp_replace(p_name, '_', ' ', 'g')), '') AS from_stem, 'B0' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS asin, 'Tale' AS album_stem, p_size AS album_disc,
  CASE WHEN p_size < 30 THEN 'ab ' || p_name ELSE left(repeat('x', 40), 27) || '...' END AS cut, p_brand = p_brand AS ok FROM part""")
def name_parts(spark, d):
    """P-S13, P-S16, P-S21, P-S22, P-S24, P-S7, P-M4: parts of file names and tags."""
    p = table(spark, d, "part")
    a = X.album_disc(F.concat(F.lit("Tale - Disc "), F.col("p_size").cast("string")))
    long = F.when(F.col("p_size") < 30, F.concat(F.lit("ab "), "p_name")).otherwise(F.lit("x" * 40))
    return p.select(
        "p_partkey", X.clean_noise(F.concat(F.lit(" [x]"), "p_name", F.lit(" and more (Unabridged)"))).alias("title"), X.track_title(F.concat(F.lit("01 - "), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("from_stem"),
        X.asin_in(F.concat(F.lit("see b0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(" there"))).alias("asin"), a["stem"].alias("album_stem"), a["disc"].alias("album_disc"),
        X.truncate(long, 30).alias("cut"), (X.safe_path(F.concat(F.lit(" a?b /"), "p_brand")) == F.concat(F.lit("a_b/"), "p_brand")).alias("ok"),
    )


@query("""
WITH t AS (SELECT l_orderkey, l_suppkey % 2 + 1 AS disc, l_linenumber - CASE WHEN l_orderkey % 3 = 0 AND l_linenumber > 2 THEN 1 ELSE 0 END AS n FROM lineitem),
d AS (SELECT l_orderkey, disc, list_sort(list(n)) AS have, len(list(n)) AS k FROM t GROUP BY ALL), w AS (SELECT *, list_filter(have, lambda x: len(list_filter(have, lambda y: y = x)) > 1) AS twice FROM d),
s AS (SELECT l_orderkey, disc, list_filter([CASE WHEN k > 1 AND have <> range(1, k + 1) THEN 'Disc ' || disc || ' has gaps in track numbering: [' || array_to_string(have, ', ') || ']' END,
  CASE WHEN len(twice) > 0 THEN 'Disc ' || disc || ' has duplicate track numbers: [' || array_to_string(twice, ', ') || ']' END], lambda x: x IS NOT NULL) AS said FROM w)
SELECT l_orderkey, array_to_string(flatten(list(said ORDER BY disc)), '; ') AS warnings FROM s GROUP BY l_orderkey""")
def set_warnings(spark, d):
    """What a set's discs say of their numbering."""
    from ..operators import tracks

    n = F.col("l_linenumber") - F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0)
    t = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2 + 1).alias("disc"), n.alias("n"))
    return tracks.numbering_warnings(t, "l_orderkey", "disc", "n").select("l_orderkey", F.array_join("warnings", "; ").alias("warnings"))


@query("""
SELECT p_partkey, CASE WHEN ok AND p_size % 5 > 0 THEN CAST(p_size * 1000 AS INTEGER) END AS bitrate, CASE WHEN ok AND p_size % 3 > 0 THEN CAST(p_size % 3 AS INTEGER) END AS channels, CASE WHEN ok THEN 44100 END AS sample_rate, CASE WHEN ok THEN 'valid' ELSE 'error' END AS status
FROM (SELECT *, p_partkey % 11 > 0 AND p_partkey % 7 > 0 AS ok FROM part)""")
def track_properties(spark, d):
    """Bitrate, channels and sampling rate of a listing; unknown and error rows have none."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    tags = F.when(k % 7 > 0, F.create_map(F.lit("TIT2"), F.col("p_name")))
    f = p.select("p_partkey", F.lit("Lib/x.mp3").alias("path"), tags.alias("tags"), F.when(k % 11 > 0, 60.0).alias("duration"), (F.col("p_size") * F.when(F.col("p_size") % 5 > 0, 1000).otherwise(0)).alias("bitrate"), (F.col("p_size") % 3).alias("channels"), F.lit(44100).alias("sample_rate"))
    return scanning.track_rows(f).select("p_partkey", "bitrate", "channels", "sample_rate", "status")
