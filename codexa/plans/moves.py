"""Queries on plans, logs and reports; orders stand for moves, customers for plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import naming, planning
from ..sources.tables import table
from .queries import query

MOVES = "m AS (SELECT o_custkey AS plan, o_orderkey AS ord, '/lib/' || o_orderpriority || '/' || o_orderkey AS old_path, '/lib/' || o_orderstatus || '/' || (o_orderkey % 1000) AS new_path, 'loses to ' || o_orderpriority AS reason FROM orders)"


def _moves(spark, d):
    o = table(spark, d, "orders")
    s = F.col("o_orderkey").cast("string")
    new = F.concat(F.lit("/lib/"), "o_orderstatus", F.lit("/"), (F.col("o_orderkey") % 1000).cast("string"))
    return o.select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("/lib/"), "o_orderpriority", F.lit("/"), s).alias("old_path"), new.alias("new_path"), F.concat(F.lit("loses to "), "o_orderpriority").alias("reason"))


#: Parts of the paths that are followed.
_PARTS = ("a", "..", ".", "", "x..y", "..", "lib", "...")


@query(f"""
WITH p AS (SELECT page_id, list_concat(['lib'], list_transform(range(5), lambda i: {list(_PARTS)}[CAST(page_id // CAST(pow({len(_PARTS)}, i) AS BIGINT) % {len(_PARTS)} + 1 AS INTEGER)])) AS parts FROM pages),
r AS (SELECT page_id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda x: [x])), lambda acc, x: CASE WHEN x[1] IN ('', '.') THEN acc WHEN x[1] = '..' THEN acc[1:len(acc) - 1] ELSE list_concat(acc, x) END) AS way FROM p)
SELECT page_id, coalesce(way[1], '') <> 'lib' AS escapes FROM r""")
def path_escape(spark, d):
    """paths that lead out of the root once followed, of five parts in all orders."""
    base = len(_PARTS)
    part = lambda i: F.get(F.array(*[F.lit(x) for x in _PARTS]), F.floor(F.col("page_id") / base**i).cast("int") % base)
    path = F.concat_ws("/", F.lit("/lib"), *[part(i) for i in range(5)])
    return table(spark, d, "pages").select("page_id", planning.escapes(path, "/lib").alias("escapes"))


@query("""
WITH a AS (SELECT p_brand AS plan, p_partkey, p_name || '.m4b' AS t, p_name || ' ' || p_partkey AS f, CASE WHEN p_size = 1 THEN p_name || '.m4b' ELSE 'old' END AS old_path FROM part),
c AS (SELECT plan, count(*) FILTER (WHERE n > 1) AS n_first FROM (SELECT plan, lower(t) AS t, count(*) AS n FROM a GROUP BY ALL) GROUP BY plan)
SELECT a.p_partkey, CASE WHEN n_first > 0 THEN f ELSE t END AS chosen FROM a JOIN c USING (plan) WHERE CASE WHEN n_first > 0 THEN f ELSE t END <> old_path""")
def m4b_fallback(spark, d):
    """a plan with shared targets takes the other template; moves that move nothing go."""
    p = table(spark, d, "part")
    m = p.select("p_partkey", F.col("p_brand").alias("plan"), F.concat("p_name", F.lit(".m4b")).alias("t"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("f"),
                 F.when(F.col("p_size") == 1, F.concat("p_name", F.lit(".m4b"))).otherwise("old").alias("old_path"))
    return planning.with_fallback(m, "plan", "t", "f").select("p_partkey", "chosen")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_linenumber * 3 AS VARCHAR), CAST(length(CAST(max(l_linenumber * 3) OVER (PARTITION BY l_orderkey) AS VARCHAR)) AS INTEGER), '0') AS track_pad FROM lineitem""")
def track_padding(spark, d):
    """W7, P-M5: numbers as wide as their book's highest."""
    li = table(spark, d, "lineitem").withColumn("i", F.col("l_linenumber") * 3)
    return planning.padded(li, "l_orderkey", "i").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.zero_pad(F.col("i"), F.col("width")).alias("track_pad"))


@query(f"""WITH {MOVES} SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY ord DESC) AS INTEGER) AS place, new_path AS old_path, old_path AS new_path FROM m""")
def undo_plan(spark, d):
    """An operation's moves taken back, last first."""
    return planning.undo(_moves(spark, d), "plan", "ord")


@query("""
WITH f AS (SELECT '/lib/' || c_nationkey || '/' || c_mktsegment AS folder, '/lib/' || c_nationkey AS up, c_acctbal > 0 AS gone FROM customer),
u AS (SELECT folder, gone FROM f UNION ALL SELECT up, gone FROM f)
SELECT folder, len(string_split(folder, '/')) AS depth FROM u GROUP BY folder HAVING bool_and(gone)""")
def emptied_folders(spark, d):
    """X3, O7, P-M9: folders that nothing is left in, with their depth."""
    f = table(spark, d, "customer").select(F.concat(F.lit("/lib/"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"), (F.col("c_acctbal") > 0).alias("gone"))
    return planning.emptied(f, "path", "gone", "/lib")


@query(f"""
WITH {MOVES}, e AS (SELECT DISTINCT '/lib/F/' || p_partkey AS path FROM part WHERE p_size = 7)
SELECT plan, count(*) FILTER (WHERE new_path IN (SELECT path FROM e)) AS n_taken, count(*) FILTER (WHERE ord % 50 = 0) AS n_inside FROM m GROUP BY plan HAVING n_taken + n_inside > 0""")
def quarantine_refusals(spark, d):
    """Plans whose targets exist, or whose files are quarantined already."""
    m = _moves(spark, d).withColumn("old_path", F.when(F.col("ord") % 50 == 0, F.concat(F.lit("/lib/.quarantine"), "old_path")).otherwise(F.col("old_path")))
    there = table(spark, d, "part").filter("p_size = 7").select(F.concat(F.lit("/lib/F/"), F.col("p_partkey").cast("string")).alias("path"))
    return planning.refusals(m, "plan", there)


@query("""
WITH f AS (SELECT DISTINCT c_mktsegment AS h, '/lib/' || CASE c_custkey % 4 WHEN 0 THEN 'Ann Lee - Tales/' WHEN 1 THEN 'misc/deep/' WHEN 2 THEN 'misc/' ELSE '' END || c_name AS path, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END AS depth, c_custkey % 4 = 0 AS s,
  c_custkey % 4 = 2 AND c_mktsegment = 'MACHINERY' AS inside FROM customer)
SELECT path, first_value(path) OVER (PARTITION BY h ORDER BY inside DESC, depth DESC, s DESC, length(path), path) AS keeper, count(*) OVER (PARTITION BY h) AS n_copies FROM f""")
def file_keeper(spark, d):
    """W4, J10, P-M9: which of equal files stays."""
    k = F.col("c_custkey") % 4
    folder = F.when(k == 0, "Ann Lee - Tales/").when(k == 1, "misc/deep/").when(k == 2, "misc/").otherwise("")
    f = table(spark, d, "customer").select(F.col("c_mktsegment").alias("h"), F.concat(F.lit("/lib/"), folder, "c_name").alias("path"), ((k == 2) & (F.col("c_mktsegment") == "MACHINERY")).alias("inside"))
    kept = f.filter("inside").select(F.col("path").alias("folder"))
    structured = F.col("path").contains("/Ann Lee - Tales/")
    return planning.file_keeper(f.drop("inside"), ["h"], "path", kept, structured).select("path", "keeper", "n_copies")


@query(f"""
WITH {MOVES} SELECT c_custkey AS plan, 0 AS line_no, '{{"plan_id":"' || c_custkey || '","operations":' || count(plan) || '}}' AS line FROM customer LEFT JOIN m ON plan = c_custkey GROUP BY c_custkey
UNION ALL SELECT plan, ord + 1, '{{"source":"' || old_path || '","destination":"' || new_path || '","reason":"' || reason || '"}}' FROM m""")
def dedupe_plan_lines(spark, d):
    """K1, K2: plans as JSON lines, one a move; a plan without moves has its head alone."""
    plans = table(spark, d, "customer").select(F.col("c_custkey").alias("plan"))
    return planning.plan_lines(_moves(spark, d).withColumn("ord", F.col("ord") + 1), "plan", "ord", plans)


@query(f"""
WITH {MOVES} SELECT plan AS operation_id, TIMESTAMP '2024-01-01' AS at, 'rename' AS operation_type, old_path, new_path, '{{"transaction_type":"dedupe","quarantine_reason":"' || reason || '"}}' AS metadata FROM m""")
def transaction_rows(spark, d):
    """What a plan leaves in the log."""
    return planning.log_rows(_moves(spark, d), "plan", "dedupe", F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query(f"""
WITH {MOVES}, c AS (SELECT plan, count(*) FILTER (WHERE n > 1) AS k FROM (SELECT plan, lower(new_path) AS t, count(*) AS n FROM m GROUP BY ALL) GROUP BY plan)
SELECT plan, 'Books: ' || count(DISTINCT reason) || ' | Operations: ' || count(*) || ' | Conflicts: ' || any_value(k) AS text FROM m JOIN c USING (plan) GROUP BY plan""")
def plan_summary(spark, d):
    """K9, K8: a plan in a line."""
    return planning.summary(_moves(spark, d), "plan", "reason")


@query(f"""WITH {MOVES} SELECT plan, ord, substr(old_path, 6) || ' -> ' || new_path AS line FROM (SELECT plan, ord, old_path, CASE WHEN starts_with(new_path, '/lib/F/') THEN replace(new_path, '/lib/F/', '/other/') ELSE substr(new_path, 6) END AS new_path FROM m)""")
def plan_diff(spark, d):
    """K9: moves relative to the root."""
    m = _moves(spark, d)
    return m.select("plan", "ord", planning.diff_line(F.col("old_path"), F.replace("new_path", F.lit("/lib/F/"), F.lit("/other/")), "/lib").alias("line"))


@query("""
SELECT p_brand, count(*) = count(DISTINCT p_size) AND count(DISTINCT p_type) = 1 AS is_sequence FROM part GROUP BY p_brand""")
def numbered_segments(spark, d):
    """P-S25, F24: groups whose names differ in their number alone."""
    p = table(spark, d, "part").withColumn("label", F.concat("p_type", F.lit(" Disc "), F.col("p_size").cast("string")))
    return planning.segments(p, "p_brand", "label", X.normalize_title)


@query("""
WITH RECURSIVE c AS (SELECT c_custkey // 40 AS book, c_custkey AS ord, 'CD' || (c_custkey % 9) AS folder, c_mktsegment AS stem, row_number() OVER (PARTITION BY c_custkey // 40 ORDER BY c_custkey) AS i FROM customer),
o AS (SELECT book, ord, i, list_concat([stem || '.nfo', folder || ' - ' || stem || '.nfo'], list_transform(range(2, 100), lambda k: stem || ' (' || k || ').nfo')) AS ways FROM c),
r AS (SELECT book, ord, i, ways[1] AS new_name, [lower(ways[1])] AS taken FROM o WHERE i = 1
  UNION ALL SELECT o.book, o.ord, o.i, list_filter(o.ways, lambda x: NOT list_contains(r.taken, lower(x)))[1], list_append(r.taken, lower(list_filter(o.ways, lambda x: NOT list_contains(r.taken, lower(x)))[1])) FROM r JOIN o ON o.book = r.book AND o.i = r.i + 1)
SELECT book, ord, new_name FROM r""")
def companion_names(spark, d):
    """W6, UD7, T6: a book's companions keep their names, the first of each; later ones get others."""
    c = table(spark, d, "customer")
    e = c.select(F.floor(F.col("c_custkey") / 40).alias("book"), F.col("c_custkey").alias("ord"), F.concat(F.lit("CD"), (F.col("c_custkey") % 9).cast("string")).alias("folder"), F.concat("c_mktsegment", F.lit(".nfo")).alias("name"))
    return naming.companions(e)


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_orderstatus AS target FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P'""")
def preview(spark, d):
    """Tracks beside the move that is planned for them, if any."""
    ops = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("target"))
    return table(spark, d, "lineitem").join(ops, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target")


@query("""
SELECT o_orderstatus AS kind, o_orderkey AS subject FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 20""")
def issue_examples(spark, d):
    """The first examples of each kind, for display."""
    # By a salt first, so that a hot kind isn't sorted in one task.
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("subject"))
    part = Window.partitionBy("kind", F.pmod(F.xxhash64("subject"), F.lit(64))).orderBy("subject")
    few = o.withColumn("i", F.row_number().over(part)).filter("i <= 20").drop("i")
    whole = Window.partitionBy("kind").orderBy("subject")
    return few.withColumn("i", F.row_number().over(whole)).filter("i <= 20").drop("i")


@query("""
SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_totalprice >= 200000) AS matched, count(*) FILTER (WHERE o_totalprice < 200000 AND o_orderstatus <> 'P') AS unmatched, count(*) FILTER (WHERE o_totalprice < 200000 AND o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey""")
def match_run_summary(spark, d):
    """What came of each run's searches."""
    hit = F.col("o_totalprice") >= 200000
    lost = F.col("o_orderstatus") == "P"
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(hit).alias("matched"), F.count_if(~hit & ~lost).alias("unmatched"), F.count_if(~hit & lost).alias("failed"))


@query("""
SELECT 'AUDIO' AS kind, c_mktsegment AS name FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT 'AUDIO', c_mktsegment FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'ONLY', n FROM (SELECT DISTINCT c_name AS n FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT c_name FROM customer WHERE c_nationkey = 3)""")
def row_sets(spark, d):
    """Intersection, difference and union of row sets."""
    c = table(spark, d, "customer")
    both = c.filter("c_acctbal > 5000").select("c_mktsegment").intersect(c.filter("c_acctbal < 0").select("c_mktsegment"))
    only = c.filter("c_acctbal > 5000").select("c_name").subtract(c.filter("c_nationkey = 3").select("c_name"))
    return both.select(F.lit("AUDIO").alias("kind"), F.col("c_mktsegment").alias("name")).unionByName(only.select(F.lit("ONLY").alias("kind"), F.col("c_name").alias("name")))


@query("""
SELECT c_custkey, c_custkey % 4 = 1 AS has_unknown, c_custkey % 4 = 2 AS has_forbidden, c_custkey % 4 = 3 AS is_unbalanced FROM customer""")
def template_problems(spark, d):
    """what is wrong with each template of a table."""
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, "{Author}/{Title}").when(k == 1, "{Nope}/{Title:02}").when(k == 2, "{Title}?").otherwise("{Title")
    p = naming.template_problems(t, ["Author", "Title"])
    return table(spark, d, "customer").select("c_custkey", (F.size(p["unknown"]) > 0).alias("has_unknown"), p["forbidden"].alias("has_forbidden"), p["unbalanced"].alias("is_unbalanced"))
