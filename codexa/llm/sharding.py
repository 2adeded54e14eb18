"""Sharding by extendible hashing (DataFrame only).

The directory is indexed by the leading bits of a document's hash.  A bucket
whose documents exceed the byte limit is split on the next bit, and only such
a bucket, until every one fits.  Byte sums by prefix are all that this takes:
a round adds ``STEP`` bits, and keys of buckets that fit leave the rounds.
The hash is md5 of the doc_id followed by md5 of the text, so a doc_id that
very many rows have still splits.

Rows that share doc_id and text can't be parted by their hash.  If such rows
exceed the limit together, they are dealt one after the other: their copies are
numbered within each partition of a checkpointed table, and a window over one
row a partition continues the numbers, so each sub-shard but the last has as
many copies as the limit holds, however the table is partitioned.

Defined results: a null text has 0 bytes, a null doc_id hashes as ``null``; a
document above the limit has a shard of its own (``oversized``), and so has
each of its copies; ``shard_bytes`` are those of the sub-shard where rows are
dealt; an empty table gives no rows; other columns pass through, and columns
named as those that are added are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import apart, cut, documents, small

LIMIT_BYTES = 16 * 1024 * 1024
STEP = 12
MAX_BITS = 256
#: Buckets that may be broadcast: some sixty bytes each.
BROADCAST_BUCKETS = 200_000
ADDED = ("shard", "shard_bytes", "oversized")

#: A limit that the smallest tables exceed many times over.
SMALL_BYTES = 64 * 1024


def _sql(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS UBIGINT) AS h
  FROM documents),
p AS (SELECT doc_id, bytes, l.n AS len, h >> (32 - l.n) AS v FROM d, (SELECT unnest(range(0, 25)) AS n) l),
s AS (SELECT len, v, sum(bytes) AS shard_bytes, count(*) AS n FROM p GROUP BY len, v),
f AS (SELECT p.doc_id, p.bytes, p.len, p.v, s.shard_bytes,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.len) AS k
      FROM p JOIN s USING (len, v) WHERE s.shard_bytes <= {limit} OR s.n = 1)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes,
       's' || CASE WHEN len = 0 THEN '' ELSE lpad(bin(v), CAST(len AS INTEGER), '0') END AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {limit} AS oversized
FROM f WHERE k = 1
"""


ORACLE_SQL, SMALL_SQL = _sql(LIMIT_BYTES), _sql(SMALL_BYTES)


def _hex(doc_id: Column, text: Column) -> Column:
    return F.concat(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _bits(digits: Column) -> Column:
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def _digits(bits: int) -> int:
    return -(-bits // 4)


def directory(rows: DataFrame, limit: int, step: int = STEP) -> DataFrame:
    """Buckets (prefix, len, bytes, n, one) for a cut (shard_key, bytes) table; one: all its rows share a key.

    A round's sums by prefix are partial before the exchange, so no row of a document is moved.
    """
    found, depth = [], 0
    sums_of = [F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    rest = rows.select("shard_key", "bytes", F.lit(1).cast("long").alias("n"), F.col("shard_key").alias("low"), F.col("shard_key").alias("high"))
    while True:
        deepest = min(depth + step, MAX_BITS)
        first = depth + (depth > 0)
        fine = rest.groupBy(F.substring("shard_key", 1, _digits(deepest)).alias("d")).agg(*sums_of)
        fine = fine.withColumn("p", F.substring(_bits(F.col("d")), 1, deepest))
        lens = fine.withColumn("len", F.explode(F.sequence(F.lit(first), F.lit(deepest))))
        sums = lens.groupBy("len", F.substring(F.col("p"), F.lit(1), F.col("len")).alias("prefix")).agg(*sums_of)
        alike = F.array_position(F.zip_with(F.split("low", ""), F.split("high", ""), lambda a, b: a != b), True) - 1
        sums = cut(sums.select("len", "prefix", "bytes", "n", (F.col("low") == F.col("high")).alias("one"), (4 * alike).alias("alike")))
        fits = (F.col("bytes") <= limit) | F.col("one")
        # A bucket is the shortest prefix that fits; before the round's first bit all were known not to.
        parents = sums.filter(~fits).select((F.col("len") + 1).alias("len"), F.col("prefix").alias("parent"))
        child = sums.filter(fits).withColumn("parent", F.substring(F.col("prefix"), F.lit(1), F.col("len") - 1))
        found.append(child.filter(F.col("len") == first).drop("parent"))
        found.append(child.filter(F.col("len") > first).join(parents, ["len", "parent"], "left_semi").drop("parent"))
        over = sums.filter((F.col("len") == deepest) & ~fits).select(F.col("prefix").alias("over"))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, found).drop("alike")
        # Bits that all rows of every such bucket share part nothing, and are passed over.
        shared = sums.filter((F.col("len") == deepest) & ~fits).agg(F.min("alike")).first()[0]
        over, _ = small(over, BROADCAST_BUCKETS)
        rest = cut(rest.join(over, F.substring(_bits(F.substring("shard_key", 1, _digits(deepest))), 1, deepest) == F.col("over"), "left_semi"))
        depth = max(deepest, shared)


def _deal(hot: DataFrame) -> DataFrame:
    """Of a cut table of rows that share their shard_key: each one's place among them, from 0, as ``copy``."""
    hot = hot.withColumn("copy_at", F.monotonically_increasing_id()).withColumn("copy_part", F.spark_partition_id())
    inside = Window.partitionBy("shard_key", "copy_part").orderBy("copy_at")
    before = Window.partitionBy("shard_key").orderBy("copy_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = hot.groupBy("shard_key", "copy_part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")))
    hot = hot.withColumn("copy", F.row_number().over(inside) - 1).join(starts.drop("count"), ["shard_key", "copy_part"])
    return hot.withColumn("copy", F.col("copy") + F.col("start")).drop("copy_at", "copy_part", "start")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, step: int = STEP) -> DataFrame:
    """The documents with shard, shard_bytes and oversized."""
    docs, restore = apart(docs.drop(*ADDED), ("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    keyed = docs.withColumn("shard_key", _hex(F.col("doc_id"), F.col("text")))
    rows = cut(keyed.select("shard_key", size.alias("bytes")))
    buckets = cut(directory(rows, limit, step))
    depths = [r["len"] for r in buckets.select("len").distinct().collect()] or [0]  # MAX_BITS + 1 values at most
    bits = _bits(F.substring("shard_key", 1, _digits(max(depths))))
    prefix = F.explode(F.array(*[F.substring(bits, 1, n) for n in sorted(depths)])).alias("prefix")
    place = F.concat(F.lit("s"), "prefix").alias("shard")
    over = (F.col("bytes") > limit).alias("oversized")
    known, fits = small(buckets, BROADCAST_BUCKETS)
    if fits:
        placed = keyed.select("*", prefix).join(known, "prefix")
    else:
        # One row a key: only these meet the directory.
        keys = rows.select("shard_key").distinct().select("shard_key", prefix).join(buckets, "prefix")
        placed = keyed.join(keys, "shard_key")
    dealt = F.col("one") & (F.col("n") > 1) & (F.col("bytes") > limit)
    hot = not buckets.filter(dealt).isEmpty()
    plain = placed.filter(~dealt) if hot else placed
    out = plain.select(*docs.columns, place, F.col("bytes").alias("shard_bytes"), over)
    if hot:
        each = F.col("bytes") / F.col("n")
        copies = _deal(cut(placed.filter(dealt)))
        copies = copies.withColumn("per", F.greatest(F.lit(1), F.floor(limit / each)).cast("long")).withColumn("deal", F.floor(F.col("copy") / F.col("per")))
        own = (F.least(F.col("per"), F.col("n") - F.col("deal") * F.col("per")) * each).cast("long")
        name = F.concat_ws("-", place, F.col("deal").cast("string")).alias("shard")
        out = out.unionByName(copies.select(*docs.columns, name, own.alias("shard_bytes"), (own > limit).alias("oversized")))
    return restore(out)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shard(docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).drop("text")


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a limit that makes it split often."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return shard(docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), SMALL_BYTES).drop("text")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


def write_shards(sharded: DataFrame, path: str, codec: str = "zstd") -> None:
    """One folder a shard; rows meet by shard, and no shard exceeds the limit."""
    sharded.repartition("shard").write.partitionBy("shard").option("compression", codec).parquet(path)
