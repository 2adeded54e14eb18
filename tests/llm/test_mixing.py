import corpus
import harness
import pytest
from codexa.llm import mixing


def brute_targets(sizes):
    """Shares by weight; those above their cap are clamped and the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, got = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            return got | {s: left * w[s] / total for s in open_}
        for s in over:
            got[s] = 2.0 * sizes[s]
        left -= sum(got[s] for s in over)
        open_ -= over
    return got


def sizes_of(data):
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    return sizes


@pytest.mark.parametrize("rows", [mixing.ROWS_A_BUCKET, 3])
def test_targets_and_taken(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", rows)
    data = corpus.rows()
    want, sizes = brute_targets(sizes_of(data)), sizes_of(data)
    of = {d: (s, len((t or "").split())) for d, t, _, s, _ in data}
    rows = mixing.mix(corpus.frame(spark)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(of)
    taken = {}
    for r in rows:
        source, size = of[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source])
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * size
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(corpus.frame(spark)).collect()))


@pytest.mark.parametrize("sizes", [{f"s{i}": 100 for i in range(3)}, {f"s{i:02}": 1000 + 37 * (i * i % 11) for i in range(20)}, {f"s{i:02}": 3**i for i in range(12)}])
def test_targets_with_several_below_their_caps(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), mixing.BUDGET, mixing.MAX_EPOCHS).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(brute_targets(sizes))
    assert sum(r["target"] for r in rows) == pytest.approx(1.5 * sum(sizes.values()))


def test_stage_keeps_every_source(spark):
    data = [(i, "one two three four five", "en", f"s{i % 20:02}", 0) for i in range(200)]
    got = {r["source"]: r["count"] for r in mixing.mix_stage(spark, corpus.frame(spark, data), "").groupBy("source").count().collect()}
    want = brute_targets(sizes_of(data))
    assert all(abs(got.get(s, 0) * 5 - want[s]) <= 5 for s in want)


@pytest.mark.parametrize("rows", [mixing.ROWS_A_BUCKET, 3])
def test_stage_repeats_whole_documents(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", rows)
    data = corpus.rows()
    docs = corpus.frame(spark).selectExpr("*", "1 AS mix_key", "2 AS part")
    out = mixing.mix_stage(spark, docs, "")
    assert out.columns == docs.columns
    got, longest = {}, max(len((t or "").split()) for _, t, *_ in data)
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len((r["text"] or "").split())
    want = brute_targets(sizes_of(data))
    assert all(abs(got.get(s, 0) - want[s]) <= longest for s in want)
    empty = {d for d, t, *_ in data if not (t or "").split()}
    assert empty <= {r["doc_id"] for r in out.collect()}


def test_sql(spark):
    con = harness.connect("/root/testdata/sf0.01")
    assert harness.differences(mixing.op5_mix_sources(spark, "/root/testdata/sf0.01"), con, mixing.ORACLE_SQL) == ""


def test_odd_tables(spark):
    assert mixing.mix(corpus.frame(spark, [])).count() == 0
    assert mixing.mix_stage(spark, corpus.frame(spark, []), "").count() == 0
    same = [(None, "a b c d", None, None, 0)] * 10
    assert sum(r["taken"] for r in mixing.mix(corpus.frame(spark, same)).collect()) == 60
    nothing = [(1, None, None, "s", 0), (2, " ", None, "s", 0)]
    assert [r["taken"] for r in mixing.mix(corpus.frame(spark, nothing)).collect()] == [0, 0]
