"""Queries on plans of moves, compared snapshots, a server's answers, and tables that are brought up to date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import renames, snapshots
from ..sources import documents, providers, server
from ..sources.tables import table
from .pages import _cat
from .queries import query


@query("""
WITH o AS (SELECT o_custkey, '/l/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, o_custkey % 3 AS m, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(o_custkey AS VARCHAR) AS plan FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
t AS (SELECT *, lead(path) OVER w AS onward, first_value(path) OVER w AS head, last_value(path) OVER (PARTITION BY o_custkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail, path || '.tmp_' || left(sha256(plan || chr(10) || path), 8) AS aside FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY rn))
SELECT plan, tail AS chain, n - rn AS step, path AS source, coalesce(onward, CASE m WHEN 0 THEN '/new/' ELSE '/stay/' END || plan) AS target, 'move' AS kind, m = 2 AS blocked FROM t WHERE m <> 1
UNION ALL SELECT plan, head, n - rn + 1, path, coalesce(onward, head), 'move', FALSE FROM t WHERE m = 1 AND rn > 1
UNION ALL SELECT plan, head, 0, path, aside, 'aside', FALSE FROM t WHERE m = 1 AND rn = 1 AND n > 1
UNION ALL SELECT plan, head, n, aside, onward, 'back', FALSE FROM t WHERE m = 1 AND rn = 1 AND n > 1""")
def move_order(spark, d):
    """The order of a plan's moves: chains from their free end, cycles by a temporary name, and what a file that stays blocks.  No file is moved."""
    o = table(spark, d, "orders")
    plan, m = F.col("o_custkey").cast("string"), F.col("o_custkey") % 3
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    path = _cat("/l/", F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    rows = o.select("o_custkey", "o_orderkey", plan.alias("plan"), path.alias("old"), m.alias("m"))
    after = F.when(F.col("m") == 0, _cat("/new/", F.col("plan"))).when(F.col("m") == 1, F.first("old").over(w)).otherwise(_cat("/stay/", F.col("plan")))
    moves = rows.select("plan", "old", F.coalesce(F.lead("old").over(w), after).alias("new"))
    files = rows.select("plan", F.col("old").alias("path")).unionByName(rows.select("plan", _cat("/stay/", F.col("plan")).alias("path")).distinct())
    return renames.ordered(moves, files)


_SNAPSHOTS = """b AS (SELECT '/lib/' || source || '/' || lang || '/' || doc_id || '.mp3' AS path, n_chars AS size, doc_id % 7 AS modified, doc_id AS name FROM documents WHERE doc_id % 50 <> 4),
a AS (SELECT CASE WHEN doc_id % 50 = 3 THEN '/lib/moved/' || lang || '/' ELSE '/lib/' || source || '/' || lang || '/' END || doc_id || '.mp3' AS path, CASE WHEN doc_id % 50 = 2 THEN n_chars + 1 ELSE n_chars END AS size, doc_id % 7 AS modified, doc_id AS name FROM documents WHERE doc_id % 50 <> 1)"""


def _snapshots(spark, d):
    """Two listings of a library: files vanish, change, move and come between them."""
    docs = table(spark, d, "documents")
    m, key = F.col("doc_id") % 50, F.col("doc_id")
    at = _cat("/lib/", F.col("source"), "/", F.col("lang"), "/", key, ".mp3")
    before = docs.filter(m != 4).select(at.alias("path"), F.col("n_chars").alias("size"), (key % 7).alias("modified"))
    now = docs.filter(m != 1).select(F.when(m == 3, _cat("/lib/moved/", F.col("lang"), "/", key, ".mp3")).otherwise(at).alias("path"), F.when(m == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), (key % 7).alias("modified"))
    return before, now


@query(f"""
WITH {_SNAPSHOTS}, f AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.name, b.name) AS name, coalesce(a.size, b.size) AS size, coalesce(a.modified, b.modified) AS modified,
  CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'vanished' WHEN a.size <> b.size OR a.modified <> b.modified THEN 'changed' END AS kind FROM a FULL JOIN b ON a.path = b.path),
m AS (SELECT max(path) FILTER (WHERE kind = 'added') AS path, max(path) FILTER (WHERE kind = 'vanished') AS moved_from FROM f WHERE kind IN ('added', 'vanished') GROUP BY name, size, modified HAVING count(*) FILTER (WHERE kind = 'added') = 1 AND count(*) FILTER (WHERE kind = 'vanished') = 1)
SELECT f.path, CASE WHEN m.path IS NULL THEN f.kind ELSE 'moved' END AS kind, m.moved_from FROM f LEFT JOIN m ON f.path = m.path WHERE f.kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m x WHERE x.moved_from = f.path)""")
def listing_changes(spark, d):
    """What changed between two listings; files are compared in changed folders alone."""
    return snapshots.changes(*_snapshots(spark, d))


@query(f"""
WITH {_SNAPSHOTS}, f AS (SELECT coalesce(a.path, b.path) AS path FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.modified <> b.modified),
p AS (SELECT string_split(path, '/') AS parts FROM f), u AS (SELECT parts, unnest(range(1, len(parts))) AS n FROM p)
SELECT array_to_string(parts[1:n], '/') AS folder, bool_or(n = len(parts) - 1) AS relist FROM u GROUP BY folder""")
def folders_to_list(spark, d):
    """The folders whose trees changed, and whether files in the folder itself did."""
    before, now = _snapshots(spark, d)
    return snapshots.to_list(snapshots.digests(before), snapshots.digests(now))


_ITEM = """'i' || c_custkey AS id, c_name AS name, c_mktsegment AS author"""


@query(f"""
WITH c AS (SELECT *, c_custkey % 9 AS m, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS DOUBLE) AS f, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS BIGINT) AS n FROM customer)
SELECT c_custkey, 'libraries' AS endpoint, p AS place, CASE p WHEN 0 THEN 'l' || c_custkey ELSE 'x' END AS id, CASE p WHEN 0 THEN c_name END AS name, s AS author, f AS progress, f AS seconds, b AS finished, s AS updated, n AS members, n AS total FROM c, (SELECT unnest([0, 1]) AS p) WHERE m IN (0, 1)
UNION ALL SELECT c_custkey, 'collections', 0, 'c' || c_custkey, c_name, s, f, f, b, s, 3, n FROM c WHERE m = 2
UNION ALL SELECT c_custkey, 'items', 0, {_ITEM}, f, f, b, s, n, c_nationkey FROM c WHERE m = 3
UNION ALL SELECT c_custkey, 'items', 1, 'second', 'Plain', s, f, f, b, s, n, c_nationkey FROM c WHERE m = 3
UNION ALL SELECT c_custkey, 'search', p, {_ITEM}, f, f, b, s, n, n FROM c, (SELECT unnest([0, 1]) AS p) WHERE m = 4
UNION ALL SELECT c_custkey, 'item', 0, {_ITEM}, f, f, b, s, n, n FROM c WHERE m = 5
UNION ALL SELECT c_custkey, 'progress', 0, 'i' || c_custkey, s, s, c_nationkey / 100.0::DOUBLE, CAST(c_custkey AS DOUBLE), c_custkey % 2 = 0, '2024-01-01T00:00:00', n, n FROM c WHERE m = 6
UNION ALL SELECT c_custkey, 'stats', 0, s, s, s, f, CAST(c_custkey * 60 AS DOUBLE), b, s, 2, 1 FROM c WHERE m = 7""")
def server_answers(spark, d):
    """Libraries, collections, pages, hits, items, progress and statistics, wrapped or not, in one shape."""
    c, m, key = table(spark, d, "customer"), F.col("c_custkey") % 9, F.col("c_custkey")
    item = _cat('{"id":"i', key, '","media":{"metadata":{"title":"', F.col("c_name"), '","authorName":"', F.col("c_mktsegment"), '"}}}')
    libraries = _cat('[{"id":"l', key, '","name":"', F.col("c_name"), '"},{"id":"x"}]')
    shapes = [
        ("libraries", _cat('{"libraries":', libraries, "}")), ("libraries", libraries), ("collections", _cat('{"collections":[{"id":"c', key, '","name":"', F.col("c_name"), '","books":[1,"b",{}]}]}')),
        ("items", _cat('{"results":[', item, ',{"id":"second","title":"Plain"},7],"total":', F.col("c_nationkey"), "}")), ("search", _cat('{"book":[{"libraryItem":', item, "},", item, "]}")), ("item", item),
        ("progress", _cat('{"libraryItemId":"i', key, '","progress":', F.col("c_nationkey") / 100, ',"currentTime":', key, ',"isFinished":', key % 2 == 0, ',"lastUpdate":"2024-01-01T00:00:00"}')), ("stats", _cat('{"totalTime":', key * 60, ',"days":{"a":1,"b":2},"recentSessions":[{}]}')), ("items", F.lit('{"results":')),
    ]
    endpoint, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, text) in enumerate(shapes):
        endpoint, body = F.when(m == i, name).otherwise(endpoint), F.when(m == i, text).otherwise(body)
    return server.answers(c.select("c_custkey", endpoint.alias("e"), body.alias("body")), ["c_custkey"], "e", "body")


@query("""
SELECT p_partkey, p_name AS title, 'https://x/books/' || p_partkey AS external_id, CASE WHEN p_size > 25 THEN 'https://c/' || p_size || '-L.jpg|https://c/' || p_size || '-S.jpg' ELSE '' END AS covers, CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'X' END AS isbn_10, CASE WHEN p_partkey % 2 = 1 THEN '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS isbn_13
FROM part WHERE p_partkey % 7 <> 0""")
def record_covers(spark, d):
    """A record by code with its address, its covers from large to small, and the code asked for, long or short."""
    p, key = table(spark, d, "part"), F.col("p_partkey")
    cover = F.when(F.col("p_size") > 25, _cat(',"cover":{"large":"https://c/', F.col("p_size"), '-L.jpg","medium":"","small":"https://c/', F.col("p_size"), '-S.jpg"}')).otherwise("")
    j = _cat('{"url":"https://x/books/', key, '","title":"', F.when(key % 7 == 0, "").otherwise(F.col("p_name")), '"', cover, "}")
    asked = F.when(key % 2 == 0, _cat(F.lpad(key.cast("string"), 9, "0"), "-x")).otherwise(_cat("978-", F.lpad(key.cast("string"), 10, "0")))
    found = providers.product_page(p.select("p_partkey", j.alias("j"), asked.alias("asked")), "j", F.col("asked")).filter("title IS NOT NULL")
    return found.select("p_partkey", "title", "external_id", F.array_join("cover_urls", "|").alias("covers"), "isbn_10", "isbn_13")


@query("""
WITH c AS (SELECT user_id || '|' || event_type AS key, epoch_us(ts) // 3600000000 AS cached_at, event_id, value AS response, event_id % 2 AS fresh FROM events),
t AS (SELECT * FROM c WHERE fresh = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY cached_at DESC, event_id DESC) = 1), r AS (SELECT * FROM c WHERE fresh = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY cached_at DESC, event_id DESC) = 1)
SELECT coalesce(t.key, r.key) AS key, CASE WHEN t.key IS NULL OR r.cached_at >= t.cached_at THEN r.cached_at ELSE t.cached_at END AS cached_at, CASE WHEN t.key IS NULL OR r.cached_at >= t.cached_at THEN r.response ELSE t.response END AS response FROM t FULL JOIN r ON t.key = r.key""")
def cache_upserts(spark, d):
    """A cache with each key's newest answer; a fresh one replaces one of the same hour."""
    e = table(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.floor(F.unix_micros("ts") / 3_600_000_000).alias("cached_at"), "event_id", F.col("value").alias("response"))
    newest = lambda df: df.groupBy("key").agg(F.max(F.struct("cached_at", "event_id", "response")).alias("n")).select("key", "n.cached_at", "n.response")
    old, new = (newest(e.filter(F.col("event_id") % 2 == r)) for r in (0, 1))
    return documents.upsert(old, new, "key", "cached_at")
