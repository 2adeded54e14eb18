"""Queries on logs, sidecars, caches and reports; rows of the tables become documents, well formed and not."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import local, matching, planning
from ..sources import documents, logs, providers, sidecars
from ..sources.tables import table
from ..streaming import progress
from .queries import query

NOW = "2024-02-01 00:00:00"


def _logs(spark, d):
    """A log for each order: some broken, some without an id, some old, some taken back, some in quarantine."""
    o = table(spark, d, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    m = k % 10
    moves = F.array(F.struct(F.lit("/lib/a").alias("old_path"), F.concat(F.when(m == 3, "/lib/.quarantine/").otherwise("/lib/"), s).alias("new_path")), F.struct(F.lit("/lib/b").alias("old_path"), F.lit("/lib/c").alias("new_path")))
    body = F.to_json(F.struct(F.when(m != 1, F.concat(F.lit("t"), s)).alias("transaction_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.when(m == 4, F.col("o_orderpriority")).when(m == 5, "").alias("transaction_type"), F.slice(moves, F.lit(1), (k % 2 + 1).cast("int")).alias("operations")))
    body = F.when(m == 2, F.left(body, F.length(body) - 4)).when(m == 9, F.lit("[1, 2]")).otherwise(body)
    path = F.concat(F.when(m == 6, "/lib/.quarantine/").otherwise("/logs/"), F.lit("transaction_"), s, F.when(k % 7 == 0, ".undone").when(k % 7 == 1, ".txt").otherwise(".json"))
    return o.select(path.alias("path"), (F.lit(NOW).cast("timestamp") - F.make_dt_interval((k % 45).cast("int"))).alias("modified"), body.alias("body"))


@query(f"""
WITH o AS (SELECT *, o_orderkey % 10 AS m, o_orderkey % 7 AS e FROM orders)
SELECT 't' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE WHEN m = 4 THEN o_orderpriority WHEN m = 3 OR m = 6 THEN 'dedupe' ELSE 'rename' END AS transaction_type, o_orderkey % 2 + 1 AS operation_count, e <> 0 AS can_undo, CASE WHEN e = 0 THEN 'undone' END AS status
FROM o WHERE m NOT IN (1, 2, 9) AND (e = 0 OR (e <> 1 AND o_orderkey % 45 <= 30))""")
def transaction_list(spark, d):
    """Logs that parse and aren't too old, with what they did; sorted newest first."""
    return logs.transactions(_logs(spark, d), F.lit(NOW).cast("timestamp")).orderBy(F.desc("timestamp"))


@query("""SELECT count(*) AS n_outdated, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n_undone FROM orders WHERE o_orderkey % 45 > 30""")
def outdated_logs(spark, d):
    """Logs of any kind that are past their age."""
    old = logs.outdated(_logs(spark, d), F.lit(NOW).cast("timestamp"))
    return old.agg(F.count("*").alias("n_outdated"), F.count_if(F.col("path").endswith(".undone")).alias("n_undone"))


@query("""
WITH m AS (SELECT o_custkey, '/in/' || o_orderkey AS old_path, '/out/' || o_orderstatus AS new_path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place FROM orders)
SELECT 'p' || o_custkey AS plan_id, place, old_path, new_path FROM m WHERE o_custkey % 5 NOT IN (1, 2)""")
def plan_rows(spark, d):
    """Plan documents read back; broken ones and those without moves of a plan are left out."""
    o = table(spark, d, "orders")
    moves = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda r: F.struct(F.concat(F.lit("/in/"), r["o_orderkey"].cast("string")).alias("old_path"), F.concat(F.lit("/out/"), r["o_orderstatus"]).alias("new_path")))
    plans = o.groupBy("o_custkey").agg(moves.alias("operations"))
    k = F.col("o_custkey") % 5
    body = F.to_json(F.struct(F.when(k != 1, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("plan_id"), "operations"))
    return logs.plans(plans.select(F.when(k == 2, F.left(body, F.length(body) - 2)).otherwise(body).alias("body")))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE c_name END AS title, CASE c_custkey % 6 WHEN 0 THEN 'Ann|Bo' WHEN 1 THEN 'Cy' WHEN 2 THEN 'Ann|Bo' WHEN 4 THEN '' END AS authors,
  CASE c_custkey % 6 WHEN 0 THEN CAST(1990 + c_nationkey AS INTEGER) WHEN 2 THEN CAST(1990 + c_nationkey AS INTEGER) END AS year, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment WHEN 2 THEN 'last' END AS description FROM customer""")
def nfo_identities(spark, d):
    """NFO files as XML, else as lines; the last of a key wins, and without a title there is none."""
    c = table(spark, d, "customer")
    k, y = F.col("c_custkey") % 6, (F.col("c_nationkey") + 1990).cast("string")
    x = F.concat(F.lit("<audiobook><title>"), "c_name", F.lit("</title><author>Ann, Bo</author><year>"), y, F.lit("</year><plot>"), "c_mktsegment", F.lit("</plot></audiobook>"))
    x_artist = F.concat(F.lit(" <a><title>"), "c_name", F.lit("</title><artist>Cy</artist><year>soon</year></a>"))
    lines = F.concat(F.lit("Title: first\nauthor = Ann,Bo\nno pair\nplot: last\n TITLE : "), "c_name", F.lit("\nYear= "), y)
    text = F.when(k == 0, x).when(k == 1, x_artist).when(k == 2, lines).when(k == 3, F.lit("<a><title>cut off</ti")).when(k == 4, F.concat(F.lit("title="), "c_name", F.lit("\nyear: n/a"))).otherwise("just words")
    f = sidecars.nfo_identity(F.col("t"))
    return c.select("c_custkey", text.alias("t")).select("c_custkey", f.alias("f")).select("c_custkey", "f.title", F.array_join("f.authors", "|").alias("authors"), "f.year", "f.description")


@query("""
WITH f AS (SELECT c_nationkey AS folder, CASE c_custkey % 5 WHEN 0 THEN 'content.opf' WHEN 1 THEN 'metadata.json' WHEN 2 THEN 'z' || c_custkey || '.nfo' WHEN 3 THEN 'metadata.opf' ELSE 'cover.jpg' END AS name, CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 100 WHEN 3 THEN 1 END AS r, c_name, c_custkey % 3 > 0 AS ok FROM customer)
SELECT folder, name, c_name AS title FROM f WHERE ok AND r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder ORDER BY r, name, c_name) = 1""")
def detected_sidecar(spark, d):
    """Package documents before JSON before NFO, the first that has a title."""
    c = table(spark, d, "customer")
    k, ok = F.col("c_custkey") % 5, F.col("c_custkey") % 3 > 0
    name = F.when(k == 0, "content.opf").when(k == 1, "metadata.json").when(k == 2, F.concat(F.lit("z"), F.col("c_custkey").cast("string"), F.lit(".nfo"))).when(k == 3, "metadata.opf").otherwise("cover.jpg")
    opf = F.when(ok, documents.opf(F.col("c_name"), F.lit("x"), F.lit("en"), F.lit(None).cast("string"))).otherwise("<package><metadata><dc:title>cut")
    json = F.when(ok, F.to_json(F.struct(F.array(F.col("c_name")).alias("title")))).otherwise('{"title": ')
    body = F.when(k.isin(0, 3), opf).when(k == 1, json).otherwise(F.when(ok, F.concat(F.lit("title: "), "c_name")).otherwise("title:"))
    return sidecars.detected(c.select(F.col("c_nationkey").alias("folder"), name.alias("name"), body.alias("body")), "folder", "name", "body")


@query("""
WITH c AS (SELECT user_id % 7 AS provider, event_id, ts + INTERVAL 10 DAY AS till, user_id % 3 = 0 AS forever FROM events)
SELECT provider, count(*) AS n, count(*) FILTER (WHERE forever OR till >= TIMESTAMP '2024-01-25') AS n_left, count(*) FILTER (WHERE NOT forever AND till < TIMESTAMP '2024-01-25') AS n_cleared, count(*) FILTER (WHERE provider <> 3) AS n_without_3 FROM c GROUP BY provider""")
def cache_cleared(spark, d):
    """What is left of a cache without its expired entries, and without a source's."""
    e = table(spark, d, "events")
    cache = e.select((F.col("user_id") % 7).alias("provider"), "event_id", F.when(F.col("user_id") % 3 != 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    left, without = local.without_expired(cache, F.lit("2024-01-25 00:00:00").cast("timestamp")), local.without_provider(cache, F.lit(3))
    n = lambda df, name: df.groupBy("provider").agg(F.count("*").alias(name))
    out = n(cache, "n").join(n(left, "n_left"), "provider", "left").join(n(without, "n_without_3"), "provider", "left").fillna(0)
    return out.select("provider", "n", "n_left", (F.col("n") - F.col("n_left")).alias("n_cleared"), "n_without_3")


@query("""
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS o, l_suppkey * 1000000 + l_partkey AS s, unnest(['flag ' || l_returnflag, 'status ' || l_linestatus, 'flag ' || l_returnflag]) AS said, unnest([1, 2, 3]) AS i FROM lineitem),
f AS (SELECT k, said, min(concat(lpad(CAST(o AS VARCHAR), 3, '0'), lpad(CAST(s AS VARCHAR), 18, '0'), i)) AS seen FROM r GROUP BY k, said)
SELECT k AS l_orderkey, string_agg(said, ', ' ORDER BY seen) AS reasons FROM f GROUP BY k""")
def merged_reasons(spark, d):
    """Reasons of all sources, each once, in the order in which they were first given."""
    li = table(spark, d, "lineitem")
    order = F.struct("l_linenumber", "l_suppkey", "l_partkey")
    said = F.array(F.concat(F.lit("flag "), "l_returnflag"), F.concat(F.lit("status "), "l_linestatus"), F.concat(F.lit("flag "), "l_returnflag"))
    found = matching.reasons(li.select("l_orderkey", order.alias("ord"), said.alias("said")), "l_orderkey", "ord", "said")
    return found.select("l_orderkey", F.array_join("reasons", ", ").alias("reasons"))


@query("""
WITH q AS (SELECT o_custkey AS b, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
r AS (SELECT user_id AS b, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT q.b AS batch, CAST(q.p AS INTEGER) AS place, o_orderkey, event_id FROM q JOIN r ON q.b = r.b AND q.p = r.p""")
def zipped_results(spark, d):
    """A queue and its results by position."""
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("ord"), "o_orderkey")
    r = table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("ord"), "event_id")
    return matching.zipped(q, r, "batch", "ord")


@query("""
WITH h AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'volumes' WHEN 2 THEN 'recordings' WHEN 3 THEN 'graph' ELSE 'other' END AS source, p_brand, p_partkey FROM part)
SELECT source, p_brand, p_partkey FROM h QUALIFY row_number() OVER (PARTITION BY source, p_brand ORDER BY p_partkey) <= least(60, CASE source WHEN 'search' THEN 100 WHEN 'volumes' THEN 40 WHEN 'recordings' THEN 50 WHEN 'graph' THEN 25 ELSE 60 END)""")
def capped_hits(spark, d):
    """No more hits than were asked for, or than a source gives at once."""
    k = F.col("p_partkey") % 5
    source = F.when(k == 0, "search").when(k == 1, "volumes").when(k == 2, "recordings").when(k == 3, "graph").otherwise("other")
    hits = table(spark, d, "part").select(source.alias("source"), "p_brand", "p_partkey")
    return providers.capped(hits, "source", ["p_brand"], "p_partkey", 60).select("source", "p_brand", "p_partkey")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower('Part ' || l_suppkey || '.mp3') AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY 'Part ' || l_suppkey || '.mp3', l_linenumber, l_partkey) AS INTEGER) AS by_name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS by_track FROM f""")
def file_orders(spark, d):
    """A set's files by name, as merging takes them, beside their order by disc and track."""
    li = table(spark, d, "lineitem").withColumns({"name": F.concat(F.lit("Part "), F.col("l_suppkey").cast("string"), F.lit(".mp3")), "disc": F.col("l_linenumber") % 2})
    w = Window.partitionBy("l_orderkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w.orderBy("name", "l_linenumber", "l_partkey")).alias("by_name"), F.row_number().over(w.orderBy("disc", "l_linenumber", "l_partkey", "l_suppkey")).alias("by_track"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS warnings FROM orders WHERE o_totalprice < 50000 OR o_orderstatus = 'P'""")
def warned_sets(spark, d):
    """sets that carry warnings."""
    o = table(spark, d, "orders")
    warnings = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, F.lit("cheap")), F.when(F.col("o_orderstatus") == "P", F.lit("pending"))))
    return o.withColumn("warnings", warnings).filter(F.size("warnings") > 0).select("o_orderkey", F.array_join("warnings", ",").alias("warnings"))


@query("""
WITH t AS (SELECT l_orderkey, count(*) AS n, list_sort(list(l_linenumber)) AS have, count(*) FILTER (WHERE l_quantity < 10) AS short, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n_sets, count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS no_narrator, count(*) FILTER (WHERE have <> range(1, n + 1)) AS broken_order, count(*) FILTER (WHERE o_orderstatus <> 'F') AS no_cover,
  CAST(sum(CASE WHEN n > 1 THEN short ELSE 0 END) AS BIGINT) AS short_tracks, CAST(sum(bad) AS BIGINT) AS broken_tracks FROM t JOIN orders ON l_orderkey = o_orderkey""")
def doctor_report(spark, d):
    """What is wrong with a library, counted over sets that are summed from their tracks."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    t = li.select("l_orderkey", F.col("l_linenumber").alias("track_index"), F.col("l_quantity").alias("duration"), (F.col("l_returnflag") == "R").alias("bad"))
    sets = o.select(F.col("o_orderkey").alias("l_orderkey"), (~F.col("o_orderpriority").startswith("5")).alias("has_narrator"), (F.col("o_orderstatus") == "F").alias("has_cover"))
    return planning.doctor(t, sets, "l_orderkey", shortest=10.0)


@query("""
WITH i AS (SELECT 'missing_covers' AS kind, o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'orphaned_files', p_partkey FROM part WHERE p_size = 50),
g AS (SELECT kind, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS ks FROM i GROUP BY kind)
SELECT kind, n, '{"kind":"' || kind || '","total":' || n || ',"items":[' || ks || ']}' AS report FROM g""")
def health_json(spark, d):
    """K8: the report as JSON, a document a kind of issue."""
    a = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.lit("missing_covers").alias("kind"), F.col("o_orderkey").alias("k"))
    b = table(spark, d, "part").filter("p_size = 50").select(F.lit("orphaned_files").alias("kind"), F.col("p_partkey").alias("k"))
    g = a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("k")).alias("items"))
    return g.select("kind", "n", F.to_json(F.struct("kind", F.col("n").alias("total"), "items")).alias("report"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'refused' WHEN value < 1 THEN 'no progress' END AS error, NOT (event_type = 'error' OR value < 1) AS synced FROM events""")
def push_results(spark, d):
    """ST3: what a push says of each row; a row that fails keeps its error, and the others go on."""
    e = table(spark, d, "events")
    return progress.pushed(e, F.col("event_type") == "error", F.col("value") < 1).select("event_id", "error", "synced")


@query()
def author_fallback(spark, d):
    """Hits by author alone, kept if their title is half alike."""
    p = table(spark, d, "part")
    hits = p.select("p_brand", "p_partkey", F.concat(F.lit("The "), "p_name").alias("c_title"))
    wanted = p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("title"))
    return matching.author_fallback(hits.join(wanted, "p_brand"), "p_partkey").select("p_brand", "p_partkey", F.round("title_score", 6).alias("title_score"))
