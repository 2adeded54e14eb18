import corpus
import pytest
from codexa.llm import simhash
from codexa.operators.graph import components


def test_against_brute_force(spark):
    data = corpus.rows()
    fps = {d: corpus.simhash(t) for d, t, *_ in data}
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = corpus.components(links, ids)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(corpus.frame(spark)).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("reach", [simhash.RADIUS, simhash.FAR])
def test_layouts(reach):
    """Each is exact: radii and one for each segment exceed the reach; more fingerprints take wider segments."""
    for n in (1, 10**4, 10**6, 10**9, 10**12):
        parts = simhash.segments(n, reach)
        assert sum(q + i + 1 for *_, q, i in parts) == reach + 1
        for half in {p[0] for p in parts}:
            own = [p for p in parts if p[0] == half]
            assert [p[1] for p in own] == [sum(p[2] for p in own[:i]) for i in range(len(own))] and sum(p[2] for p in own) == 64
    sizes = [len(simhash.segments(n, reach)) for n in (1, 10**4, 10**6, 10**8, 10**10)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]


def test_far_rows_stay_in_proportion_on_disk(spark, monkeypatch):
    """No number of documents makes the stage's tables wider, and each table's look-ups are a job of their own, whose shuffle goes before the next."""
    width = lambda n: sum(simhash.math.comb(w, i) for _, _, w, q, r in simhash.segments(n, simhash.FAR) for x in (q, r) for i in range(x + 1))
    assert max(width(n) for n in (10**5, 10**6, 10**7, 10**8)) == width(10**5) < 300
    cuts, real = [], simhash.cut
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(simhash, "cut", lambda df: cuts.append((df.columns, spark.conf.get(name, "false"))) or real(df))
    df = spark.createDataFrame([(i, i * 977, i * 31) for i in range(40)], "node long, fp long, fp2 long")
    parts = simhash.segments(10**6, simhash.FAR)
    simhash.links(df, parts, simhash.FAR)
    assert cuts.count((["a", "b"], "true")) == 2 * len(parts)


@pytest.mark.parametrize("n", [1, 10**5, 10**10])
def test_far_layouts_meet_every_close_pair(spark, n):
    """Pairs of 128 bits at all distances around a few centres."""
    import random

    rng = random.Random(10)
    rows, flip = [], lambda x, m: x ^ sum(1 << b for b in rng.sample(range(64), m))
    for _ in range(8):
        c = (rng.getrandbits(64), rng.getrandbits(64))
        rows += [(flip(c[0], rng.randint(0, 11)), flip(c[1], rng.randint(0, 11))) for _ in range(14)]
    rows = sorted(set(rows))
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in r) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(signed)], "doc_id long, fp long, fp2 long")
    near = lambda a, b: (a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count() <= simhash.FAR
    want = corpus.components([(i, j) for i, a in enumerate(rows) for j in range(i + 1, len(rows)) if near(a, rows[j])], range(len(rows)))
    got = {(r["fp"], r["fp2"]): r["component_id"] for r in simhash.classes(df, simhash.segments(n, simhash.FAR), simhash.FAR).collect()}
    assert got == {r: want[i] for i, r in enumerate(signed)} and len(set(want.values())) > 8


@pytest.mark.parametrize("n", [60_000, 10**6, 10**9])
def test_segments_meet_every_close_pair(spark, n):
    """Fingerprints at all distances around a few centres: links by table look-up equal links by comparison."""
    import random

    rng = random.Random(9)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    ids = range(len(signed))
    links = [(i, j) for i in ids for j in range(i + 1, len(signed)) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 4]
    want = corpus.components(links, ids)
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df, simhash.segments(n)).collect()}
    assert got == {signed[i]: want[i] for i in ids}


def test_one_segment_value_of_very_many(spark, monkeypatch):
    """All fingerprints share a segment's bits: finer keys find the same links, in far fewer comparisons."""
    import random

    monkeypatch.setattr(simhash, "HOT_LIST", 50)
    rng = random.Random(11)
    for shared in (0, 16, 48):
        mask = ((1 << 16) - 1) << shared
        fps = {rng.getrandbits(64) & ~mask | 0xBEEF << shared for _ in range(300)}
        for f in rng.sample(sorted(fps), 120):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
        signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
        df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
        ids = range(len(signed))
        links = [(i, j) for i in ids for j in range(i + 1, len(signed)) if ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 4]
        want = corpus.components(links, ids)
        for n in (60_000, 10**9):
            got = {r["fp"]: r["component_id"] for r in simhash.classes(df, simhash.segments(n)).collect()}
            assert got == {signed[i]: want[i] for i in ids}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_stage_keeps_one_of_each_group(spark, odd):
    data = corpus.rows()
    if odd:
        data = [*data, data[0], (None, data[1][1], "en", "s", 1), (None, "lonely words that nobody else has in this corpus at all", "en", "s", 2), (None, "lonely words that nobody else has in this corpus at all", "en", "s", 2)]
    docs = corpus.frame(spark, data).selectExpr("*", "7 AS fp", "8 AS kept_id")
    kept = simhash.simhash_stage(spark, docs, "").collect()
    comp = corpus.components(corpus.far_links([r[1] for r in data]), range(len(data)))
    groups = {}
    for i, r in enumerate(data):
        groups.setdefault(comp[i], []).append(r[0])
    want = sorted(min((d for d in g if d is not None), default=-1) for g in groups.values())
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == want
    assert kept[0].asDict()["fp"] == 7 and list(kept[0].asDict()) == docs.columns


def test_stage_keeps_unrelated_rows_without_ids_of_their_own(spark):
    lone = ["lonely words that nobody else has in this corpus at all", "quite another text with nothing in common to the others", "a third one about rivers and boats in the north country"]
    data = [(None, t, "en", "s", 0) for t in (lone[0], lone[0], lone[1])]
    data += [(7, t, "en", "s", 0) for t in ("grey horses run along the empty beach before noon", "seven clocks strike at once in the old town hall", "seven clocks strike at once in the old town hall")]
    data += [(9, lone[2], "en", "s", 0), (None, lone[2], "en", "s", 0)]
    kept = simhash.simhash_stage(spark, corpus.frame(spark, data), "").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept) == sorted([(-1, lone[0]), (-1, lone[1]), (7, data[3][1]), (7, data[4][1]), (9, lone[2])])


def test_stage_orders_rows_with_maps(spark):
    docs = corpus.frame(spark, [(1, "the same words in both rows", "en", "s", 0)] * 2 + [(None, "other words entirely, and more of them", "en", "s", 0)] * 2)
    docs = docs.selectExpr("*", "map('a', monotonically_increasing_id()) AS m", "array(named_struct('m', map(1, 2))) AS deep")
    assert sorted(r["text"] for r in simhash.simhash_stage(spark, docs, "").collect()) == ["other words entirely, and more of them", "the same words in both rows"]


def test_empty(spark):
    assert simhash.near_duplicates(corpus.frame(spark, [])).count() == 0
    assert simhash.simhash_stage(spark, corpus.frame(spark, []), "").count() == 0
