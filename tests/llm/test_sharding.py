import hashlib

import corpus
import harness
import pytest
from codexa.llm import sharding


def bits(row):
    ident, text = "null" if row[0] is None else str(row[0]), row[1] or ""
    digits = hashlib.md5(ident.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()
    return "".join(f"{int(c, 16):04b}" for c in digits)


def brute(data, limit):
    size = lambda g: sum(len((data[i][1] or "").encode()) for i in g)
    todo, out = [("", list(range(len(data))))], {}
    while todo:
        prefix, group = todo.pop()
        if size(group) <= limit or len(group) == 1:
            out |= {i: ("s" + prefix, size(group), size(group) > limit) for i in group}
            continue
        for b in "01":
            if half := [i for i in group if bits(data[i])[len(prefix)] == b]:
                todo.append((prefix + b, half))
    return out


@pytest.mark.parametrize(("limit", "step"), [(10**9, 12), (20_000, 12), (3_000, 2), (500, 3)])
def test_against_brute_force(spark, limit, step):
    data = corpus.rows()
    want = brute(data, limit)
    got = {r["doc_id"]: (r["shard"], r["shard_bytes"], r["oversized"]) for r in sharding.shard(corpus.frame(spark), limit, step).collect()}
    assert got == {data[i][0]: w for i, w in want.items()}


def test_hot_ids_and_equal_rows(spark):
    hot = [(None, f"text number {i}", None, None, 0) for i in range(50)]
    got = sharding.shard(corpus.frame(spark, hot), 100, 4).groupBy("shard").agg({"shard_bytes": "max"}).collect()
    assert len(got) > 5 and all(r[1] <= 100 for r in got)
    equal = [(1, "x" * 10, None, None, 0)] * 100
    out = sharding.shard(corpus.frame(spark, equal), 200, 12).groupBy("shard").count().collect()
    assert sum(r["count"] for r in out) == 100 and max(r["count"] for r in out) <= 20


@pytest.mark.parametrize(("copies", "size", "limit", "slices"), [(32, 10, 160, 32), (32, 10, 20, 8), (32, 10, 40, 16), (4, 300, 160, 4), (7, 10, 25, 3)])
def test_copies_are_dealt_evenly(spark, copies, size, limit, slices):
    """Equal rows over the limit, one or few a partition: each shard has what the limit holds, or one row and the flag."""
    data = [(1, "x" * size, None, None, i) for i in range(copies)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(data, slices), corpus.SCHEMA)
    rows = sharding.shard(docs.unionByName(corpus.frame(spark)), limit, 12).filter("doc_id = 1").collect()
    per = max(1, limit // size)
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + size
    assert len(rows) == copies and sorted(sizes.values()) == sorted([per * size] * (copies // per) + [copies % per * size] * (copies % per > 0))
    assert all(r["shard_bytes"] == sizes[r["shard"]] and r["oversized"] == (size > limit) for r in rows)


def test_directory_beyond_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, sharding.shard(corpus.frame(spark), 3000).collect()), key=repr)
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 0)
    assert sorted(map(tuple, sharding.shard(corpus.frame(spark), 3000).collect()), key=repr) == want


def test_odd_tables(spark):
    docs = corpus.frame(spark, []).selectExpr("*", "'old' AS shard", "1 AS prefix", "2 AS parts")
    out = sharding.shard(docs)
    assert out.count() == 0 and out.columns == [*corpus.frame(spark, []).columns, "prefix", "parts", *sharding.ADDED]
    assert sharding.shard(corpus.frame(spark).selectExpr("*", "'old' AS shard", "1 AS prefix"), 5000).count() == len(corpus.rows())


def test_sql(spark):
    con = harness.connect("/root/testdata/sf0.001")
    assert harness.differences(sharding.op8_shard(spark, "/root/testdata/sf0.001"), con, sharding.ORACLE_SQL) == ""


def test_written_shards(spark, tmp_path):
    sharding.write_shards(sharding.shard(corpus.frame(spark), 20_000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(corpus.rows())
