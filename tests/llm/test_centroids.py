"""Centroid clustering against plain loops, and its SQL."""

import hashlib
import math
import random

import harness
import numpy as np
from codexa.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(vectors, key=key)[:16]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(3):
        groups: dict = {}
        for _, v in vectors:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(x) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(cents)]
    last = [(i, *near(v)) for i, v in vectors]
    own = {n: sum(d for _, d, m in last if m == n) for n in range(16)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, own[n], sum(own.values()), sha[n]) for i, d, n in last), key=repr)


def result(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, schema).repartition(5)).collect()), key=repr)


def vectors(seed, n, spread=1.0):
    """Rounded to floats as the table has them."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, spread, (n, 64)).astype(np.float32).tolist()


def test_equals_plain_loops(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(3, 300))]
    rows += [(i, rows[0][1], 0) for i in range(300, 340)]  # one vector many times: ties
    rows += [(900, [0.0] * 63, 0), (901, None, 0), (902, [None] + [0.0] * 63, 0), (903, [float("nan")] + [0.0] * 63, 0), (904, [float("inf")] + [0.0] * 63, 0), (None, [0.5] * 64, 0), (5, [0.25] * 64, 0), (905, [], 0)]
    assert result(spark, rows) == expected(rows)


def test_few_vectors_and_ties(spark):
    rows = [(i, [float(i % 2)] * 64, None) for i in range(5)]
    assert result(spark, rows) == expected(rows)
    assert result(spark, [(1, [0.0] * 3, 0)]) == [] and result(spark, []) == []


def test_large_components(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(4, 40, 1e6))]
    assert result(spark, rows) == expected(rows)
    # Beyond what a long holds, sums of distances are null.
    huge = [*rows, (77, [float(np.float32(1e30))] * 64, 0), (78, [-float(np.float32(1e30))] * 64, 0)]
    assert result(spark, huge) == sorted(((i, n, *[x if x < 1 << 63 else None for x in (d, own, every)], sha) for i, n, d, own, every, sha in expected(huge)), key=repr)


def test_other_columns(spark):
    rows = [(i, v, i, "x") for i, v in enumerate(vectors(5, 20))]
    assert result(spark, rows, "vec_id long, embedding array<float>, cluster int, distance string") == expected(rows)


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert harness.differences(centroids.op12_centroids(spark, sf), harness.connect(sf), centroids.ORACLE_SQL) == ""


def test_abandoned_centroids_change_nothing():
    rng = random.Random(8)
    v = np.array([[rng.randint(-40, 40) for _ in range(64)] for _ in range(200)])
    cents = [[rng.randint(-40, 40) for _ in range(64)] for _ in range(16)]
    order = list(range(64))
    rng.shuffle(order)
    of, far = centroids.nearest(v, cents, order)
    d = ((v[:, None, :] - np.array(cents)[None]) ** 2).sum(axis=2)
    assert of.tolist() == d.argmin(axis=1).tolist() and far.tolist() == d.min(axis=1).tolist()
