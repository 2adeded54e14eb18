"""Centroid clustering by partial-distance search over integer vectors.

A kept vector has exactly ``dims`` components, all finite; component x becomes
floor(64 * x).  Distances to a centroid grow over pieces of the components, those
in which the vectors vary most first.  A centroid is abandoned for a vector once
its partial sum is strictly above the best so far; equal ones go on, so that ties
fall to the smaller number.  Survivors finish all components.  Each partition
sends sums and counts by centroid and component only; the driver holds the
``k`` centroids, never a vector more.

Defined results: vectors of another length, or with null or non-finite
components, aren't kept; a null vec_id hashes as ``null``, and rows with equal
vec_ids are separate vectors, ordered by their components where both stand among
the first; fewer kept vectors than k give as many centroids; no kept vector gives
no rows; equal rows give equal rows; extra columns don't matter.  Components too
large for 64-bit squares are computed with whole numbers of any size, as long as
their sums have 38 digits; a distance beyond a long is null, and so are the sums
that it is part of.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import cut

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 16, 3, 1, 64
#: Components between two looks at the best.
PIECE = 8
#: Below this no sum of squares of differences leaves 64 bits.
SAFE = 1 << 27
LONG = (1 << 63) - 1

_NEAREST = """SELECT rid, vec_id, v, min(CAST(d AS HUGEINT) * 16 + c) AS best FROM (
  SELECT rid, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS d FROM k, {0}) GROUP BY rid, vec_id, v"""
_MOVED = """SELECT o.c, coalesce(n.w, o.w) AS w FROM {1} o LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM (
  SELECT CAST(best % 16 AS INTEGER) AS c, i, sum(v[i]) AS s, count(*) AS n FROM {0}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c) n ON n.c = o.c"""

ORACLE_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS w FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM k) ORDER BY h, v LIMIT 16),
a0 AS ({_NEAREST.format("c0")}), c1 AS ({_MOVED.format("a0", "c0")}),
a1 AS ({_NEAREST.format("c1")}), c2 AS ({_MOVED.format("a1", "c1")}),
a2 AS ({_NEAREST.format("c2")}), c3 AS ({_MOVED.format("a2", "c2")}),
a3 AS (SELECT vec_id, CAST(best % 16 AS INTEGER) AS cluster, CAST(best // 16 AS BIGINT) AS distance FROM ({_NEAREST.format("c3")}))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c = cluster
"""


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and embedding, as doubles, of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", x.alias("embedding")).filter((F.size("embedding") == dims) & ~bad)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where squares fit, else Python's."""
    scaled = np.floor(values * SCALE)
    if len(scaled) and np.abs(scaled).max() >= SAFE:
        return np.array([int(x * SCALE // 1) if abs(x) < 2**900 else int(x) * SCALE for x in values.ravel().tolist()], dtype=object).reshape(values.shape)
    return scaled.astype(np.int64)


def rows_of(batch, dims: int) -> np.ndarray:
    return whole(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def nearest(vectors: np.ndarray, centroids: list[list[int]], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and its squared distance, by partial sums in the order of the components."""
    kind = np.int64 if vectors.dtype != object and all(abs(x) < SAFE for c in centroids for x in c) else object
    vectors = vectors.astype(kind)[:, order]
    best, best_of = np.zeros(len(vectors), kind), np.zeros(len(vectors), np.int32)
    for number, c in enumerate(centroids):
        c = np.array(c, dtype=kind)[order]
        left, total = np.arange(len(vectors)), np.zeros(len(vectors), kind)
        for at in range(0, len(order), PIECE):
            off = vectors[left, at : at + PIECE] - c[at : at + PIECE]
            total = total + (off * off).sum(axis=1)
            if number:
                go = (total <= best[left]).astype(bool)
                left, total = left[go], total[go]
        if number:
            less = (total < best[left]).astype(bool)
            left, total = left[less], total[less]
        best[left], best_of[left] = total, number
    return best_of, best


def _sums(vectors: DataFrame, find, groups: int, dims: int) -> dict[int, tuple[int, list[int], list[int]]]:
    """By what ``find`` numbers: count, sums and sums of squares of the components; a row a group and component leaves a partition."""

    def run(batches):
        n, s, q = [0] * groups, np.zeros((groups, dims), dtype=object), np.zeros((groups, dims), dtype=object)
        for b in batches:
            v = rows_of(b, dims)
            of = find(v)
            for g in np.unique(of).tolist():
                own = v[of == g]
                n[g] += len(own)
                s[g] += own.sum(axis=0).astype(object)
                q[g] += (own.astype(object) ** 2 if own.dtype == object else own.astype(np.float64) ** 2).sum(axis=0)
        full = [(g, i) for g in range(groups) if n[g] for i in range(dims)]
        cols = [[g for g, _ in full], [i for _, i in full], [n[g] for g, _ in full], [str(s[g, i]) for g, i in full], [float(min(q[g, i], 10**300)) for g, i in full]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["g", "i", "n", "s", "q"])

    parts = vectors.select("embedding").mapInArrow(run, "g int, i int, n long, s string, q double")
    total = parts.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.sum("q").alias("q"))
    out: dict[int, tuple[int, list[int], list[int]]] = {}
    for r in total.collect():  # groups x dims rows
        n, s, q = out.setdefault(r["g"], (r["n"], [0] * dims, [0.0] * dims))
        s[r["i"]], q[r["i"]] = int(r["s"]), r["q"]
    return out


def seeds(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The first centroids: k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = vectors.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return [whole(np.array([r["embedding"]])).tolist()[0] for r in first]


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[list[list[int]], list[int]]:
    """Centroids after all rounds, and the components in falling order of variance."""
    centroids = seeds(vectors, k)
    spread = _sums(vectors, lambda v: np.zeros(len(v), np.int32), 1, dims).get(0)
    if not spread:
        return [], list(range(dims))
    n, s, q = spread
    order = sorted(range(dims), key=lambda i: (-(q[i] / n - (s[i] / n) ** 2), i))
    for _ in range(rounds):
        moved = _sums(vectors, lambda v, c=centroids: nearest(v, c, order)[0], len(centroids), dims)
        centroids = [[x // moved[g][0] for x in moved[g][1]] if g in moved else c for g, c in enumerate(centroids)]
    return centroids, order


def assign(vectors: DataFrame, centroids: list[list[int]], order: list[int]) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches):
        for b in batches:
            of, far = nearest(rows_of(b, len(order)), centroids, order)
            far = [int(x) if x <= LONG else None for x in far] if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(of, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _long(total: Column) -> Column:
    return F.when(total <= F.lit(LONG), total).cast("long")


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """The kept vectors with their cluster, distances summed over it and over all, and their centroid's digest."""
    spark, vectors = embeddings.sparkSession, kept(embeddings)
    centroids, order = fit(vectors, k, rounds)
    rows = cut(assign(vectors, centroids, order)) if centroids else vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    # A row a centroid: k at most.
    told = spark.createDataFrame([(g, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for g, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    far = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(far.alias("own"), F.count("distance").alias("known"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # over k rows at most
    sums = sums.select("*", F.sum("own").over(every).alias("all"), F.sum(F.col("n") - F.col("known")).over(every).alias("lost")).join(told, "cluster")
    sums = sums.select("cluster", _long(F.when(F.col("n") == F.col("known"), F.col("own"))).alias("cluster_inertia"), _long(F.when(F.col("lost") == 0, F.col("all"))).alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
