"""Mixing sources to target weights: capped water-filling (DataFrame only).

Every source has a weight; together the sources share a word budget.  A source
may be repeated ``cap`` times at most, so its target stops at ``cap`` times its
size and the excess goes to the others by weight until none is above.  The
fixed point is one level: target = min(weight * level, cap * size).  Whole
repetitions go to every document of a source; the fractional one goes to
documents in a seeded order until the words of the target are taken.

Defined results: a null text counts 0 words; a null source is a source of its
own, last in order; a null doc_id is a document like any other; equal rows are
separate documents; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import apart, cut, documents, small
from .textcore import WORD_JAVA

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 20240607
#: Rows that one window puts in order, about; what is above it comes in two levels of buckets.
ROWS_A_BUCKET = 1024
BROADCAST_SOURCES = 100_000

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 2.0::DOUBLE AS most FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
    sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
l AS (SELECT *, left_words / left_w AS level, w * (left_words / left_w) >= most AS clamped FROM r),
t AS (SELECT source, source_size, CASE WHEN clamped THEN most ELSE w * max(level) FILTER (WHERE NOT clamped) OVER () END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
e AS (SELECT *, CAST(round(target) AS BIGINT) - epochs * source_size AS extra FROM g),
n AS (SELECT CAST(greatest(1, ceil(sqrt(count(*) / {ROWS_A_BUCKET}.0))) AS BIGINT) AS width FROM d),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h % width, (h >> 31) % width, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d, n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + least(size, greatest(0, extra - ahead)) AS BIGINT) AS taken
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_JAVA)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target of a (source, source_size) table.

    The windows run over one row a source, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    # Clamped first: those with the least room for their weight.
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget)))
        .withColumn("left_words", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_w"))
        .withColumn("clamped", F.col("w") * F.col("level") >= F.col("most"))
        # Levels fall along the unclamped ones, as each leaves out the caps before it: the first has the caps of the clamped alone.
        .withColumn("final", F.max(F.when(~F.col("clamped"), F.col("level"))).over(every))
    )
    return t.select(*sizes.columns, F.when(F.col("clamped"), F.col("most")).otherwise(F.col("w") * F.col("final")).alias("target"))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Each document's source key, size, and place in the seeded order."""
    own = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    h = F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("mix_key"), word_count(F.col("text")).alias("mix_size"), h.alias("mix_hash"))


def _buckets(width: int) -> tuple[Column, Column]:
    """A row's coarse and fine bucket, as many of each; the order is by both, then by hash."""
    h = F.col("mix_hash")
    return F.pmod(h, F.lit(width)).alias("mix_coarse"), F.pmod(F.shiftright(h, 31), F.lit(width)).alias("mix_fine")


def _placed(keyed: DataFrame, budget: float, cap: float, weights) -> tuple[DataFrame, int]:
    """Rows of (doc_id, source, mix_*) with their source's target and their part of its last repetition; buckets a level.

    No window is larger than the square root of the rows over ROWS_A_BUCKET, or than a fine bucket of one source.
    """
    base = cut(keyed.withColumn("row", F.monotonically_increasing_id()))
    width = max(1, math.ceil(math.sqrt(base.count() / ROWS_A_BUCKET)))
    base = base.select("*", *_buckets(width))
    fine, coarse = ["mix_key", "mix_coarse", "mix_fine"], ["mix_key", "mix_coarse"]
    sums = cut(base.groupBy(*fine).agg(F.sum("mix_size").alias("words"), F.first("source").alias("source")))
    of_coarse = sums.groupBy(*coarse).agg(F.sum("words").alias("words"), F.first("source").alias("source"))
    goal = targets(of_coarse.groupBy("mix_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), budget, cap, weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("extra", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))

    def before(size, by, *order):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(w), F.lit(0).cast("long"))

    starts = of_coarse.withColumn("begin", before("words", ["mix_key"], "mix_coarse")).join(goal.drop("source"), "mix_key").drop("words", "source")
    starts = sums.withColumn("within", before("words", coarse, "mix_fine")).drop("words", "source").join(starts, coarse)
    placed = base.withColumn("ahead", before("mix_size", fine, "mix_hash", "row")).join(starts, fine)
    part = F.least(F.col("mix_size"), F.greatest(F.lit(0).cast("long"), F.col("extra") - F.col("begin") - F.col("within") - F.col("ahead")))
    return placed.withColumn("part", part), width


def mix(docs: DataFrame, budget: float = BUDGET, cap: float = MAX_EPOCHS, seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: words taken, with repeats."""
    keyed = _keyed(docs.select("doc_id", "source", "text"), seed).drop("text")
    return _placed(keyed, budget, cap, weights)[0].select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("mix_size") + F.col("part")).alias("taken")
    )


def repeat(docs: DataFrame, budget: float = BUDGET, cap: float = MAX_EPOCHS, seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Only whole documents are taken: the one at the end of a source's target
    comes if half of it is due.  Documents without words cost nothing and stay.
    The texts aren't shuffled: each source's last repetition ends at a place in
    the seeded order, and a table of one row a source tells it.
    """
    docs, restore = apart(docs, ("doc_id", "source", "text"))
    keyed = _keyed(docs, seed)
    placed, width = _placed(keyed.select("source", "mix_key", "mix_size", "mix_hash"), budget, cap, weights)
    order = ("mix_coarse", "mix_fine", "mix_hash")
    due = (F.col("mix_size") > 0) & (F.col("part") * 2 >= F.col("mix_size"))
    ends = placed.groupBy(F.col("mix_key").alias("mix_end_key")).agg(
        F.first("epochs").alias("mix_epochs"), F.max(F.when(due, F.struct(*order))).alias("mix_last")
    )
    ends, _ = small(cut(ends), BROADCAST_SOURCES)
    again = F.coalesce(F.struct(*order) <= F.col("mix_last"), F.lit(False))
    copies = F.when(F.col("mix_size") == 0, F.greatest(F.col("mix_epochs"), F.lit(1))).otherwise(F.col("mix_epochs") + again.cast("int"))
    joined = keyed.select("*", *_buckets(width)).join(ends, F.col("mix_key") == F.col("mix_end_key"))
    return restore(joined.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat(docs)
