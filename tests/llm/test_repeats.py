"""Both substring operators against brute force over all windows."""

import hashlib
from collections import Counter

import corpus
import numpy as np
import pytest
from codexa.llm import bytewise, recompression, repeats, suffixes
from codexa.llm.textcore import word_spans


def brute_words(data):
    w = {d: (t or "").encode().split() for d, t, *_ in data}
    first = {}
    for d in sorted(w):
        for i in range(len(w[d]) - 49):
            first.setdefault(b" ".join(w[d][i : i + 50]), d)
    out = {}
    for d, x in w.items():
        gone = set()
        for i in range(len(x) - 49):
            if first[b" ".join(x[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = [v for i, v in enumerate(x) if i not in gone]
        out[d] = (len(x), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(data):
    t = {d: (x or "").encode() for d, x, *_ in data}
    n = Counter(x[i : i + 400] for x in t.values() for i in range(len(x) - 399))
    out = {}
    for d, x in t.items():
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 399):
            if n[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        out[d] = (len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    """With a text of 30000 words, and one that holds a passage of it twice."""
    rows = corpus.rows()
    long = max((r[1] or "" for r in rows), key=len).split()
    return [*rows, (7001, " ".join([*long[9000:9200], "between", *long[9000:9200], *long[:70]]), "en", "s", 0)]


def test_words(spark, data):
    assert result(repeats.remove_repeats(corpus.frame(spark, data), recompression.KIND)) == brute_words(data)


@pytest.mark.parametrize("kind", [recompression.KIND, suffixes.KIND])
def test_hot_blocks(spark, monkeypatch, kind):
    """Blocks that many rows are equal to are looked up on a way of their own, with the same result."""
    monkeypatch.setattr(repeats, "HOT_ROWS", 3)
    monkeypatch.setattr(repeats, "BROADCAST_BLOCKS", 0)
    near = [r for r in corpus.rows() if len(r[1] or "") < 20_000][60:]
    near += [(900 + i, near[1][1] + f" tail {i % 3}", "en", "s", 0) for i in range(12)]
    brute = brute_words if kind.earlier else brute_bytes
    assert result(repeats.remove_repeats(corpus.frame(spark, near), kind)) == brute(near)


def test_blocks_that_repeat_in_their_first_document(spark):
    """A later document holds a line many times in one context, an earlier one in another."""
    line = " ".join(f"w{i}" for i in range(54))
    rows = [(1, f"a b c {line} d e f", None, None, 0), (2, f"x y z {line} q r s t u v " * 9, None, None, 0), (2, f"x y z {line} q r s t u v " * 3, None, None, 0), (3, f"x y z {line} q", None, None, 0)]
    got = result(repeats.remove_repeats(corpus.frame(spark, [r for r in rows if r is not rows[2]]), recompression.KIND))
    assert got == brute_words([r for r in rows if r is not rows[2]]) and got[2][1] == 9 * 54
    both = repeats.remove_repeats(corpus.frame(spark, rows), recompression.KIND).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in both) == [(1, 0), (2, 3 * 54), (2, 9 * 54), (3, 58)]
    assert result(repeats.remove_repeats(corpus.frame(spark, rows[:2]), suffixes.KIND)) == brute_bytes(rows[:2])


def test_bytes(spark, data):
    assert result(repeats.remove_repeats(corpus.frame(spark, data), suffixes.KIND)) == brute_bytes(data)


def test_bytes_of_large_keys(spark, data):
    """With room for one kind of block, every mixed key goes by windows."""
    from dataclasses import replace

    assert result(repeats.remove_repeats(corpus.frame(spark, data), replace(suffixes.KIND, resolve_rows=1))) == brute_bytes(data)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    passage = b" ".join(rng.choice([b"aa", b"b", b"cdd", b"e"], 90).tolist())
    seen = {}
    for k in range(40):
        text = b" ".join(rng.choice([b"aa", b"b", b"x", b"e"], k).tolist()) + b" " + passage + b" z" * k
        buf = np.frombuffer(text, np.uint8)
        doc, at, n, key, block = recompression.blocks(buf, np.array([0, len(buf)]))
        ws, we, _ = word_spans(buf, np.array([0, len(buf)]))
        for a, m, q in zip(at.tolist(), n.tolist(), key.tolist(), strict=True):
            for p in range(a, a + m):
                assert seen.setdefault(text[ws[p] : we[p + 49]].replace(b"  ", b" "), q) == q


def test_refinement_orders_suffixes():
    rng = np.random.default_rng(4)
    rows = [bytes(rng.integers(0, 2, rng.integers(0, 60)).astype(np.uint8)) for _ in range(200)]
    group = rng.integers(0, 5, 200)
    order, lcp = suffixes.interleave(group, np.arange(200), suffixes.symbols([np.frombuffer(r, np.uint8) for r in rows], 60))
    got = [(int(group[i]), rows[i]) for i in order]
    assert got == sorted(got)
    for i in range(1, 200):
        if lcp[i] < 0:
            assert got[i][0] != got[i - 1][0]
        else:
            a, b = got[i - 1][1], got[i][1]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert min(int(lcp[i]), len(a), len(b)) == same


@pytest.mark.parametrize("kind", [recompression.KIND, suffixes.KIND])
def test_odd_tables(spark, kind):
    long = " ".join(f"w{i}" for i in range(120))
    odd = [(None, long, None, None, 0), (None, long, None, None, 0), (4, long, "en", "s", 0), (4, long + " more", "en", "s", 0), (9, None, None, None, None)]
    got = sorted(tuple(r) for r in repeats.remove_repeats(corpus.frame(spark, odd).selectExpr("*", "1 AS key", "2 AS at"), kind).selectExpr("coalesce(doc_id, -1)", "n_removed").collect())
    n = 120 if kind is recompression.KIND else len(long)
    assert got == ([(-1, n), (-1, n), (4, 0), (4, 0), (9, 0)] if kind.earlier else [(-1, n), (-1, n), (4, n), (4, n), (9, 0)])
    assert repeats.remove_repeats(corpus.frame(spark, []), kind).count() == 0


def test_anchor_is_in_reach():
    buf = np.frombuffer(bytes(range(256)) * 8, np.uint8)
    p = np.arange(len(buf) - bytewise.WIDTH + 1)
    a = bytewise.anchors(buf, p)
    assert ((a >= p) & (a + bytewise.GRAM <= p + bytewise.REACH)).all()


def thue_morse(n):
    """A word and its complement, whose sums of powers agree modulo 2**64 for any odd base."""
    one = "a"
    while len(one) < n:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [32, 64, 512, 1024, 4096])
def test_words_built_to_collide(spark, n):
    """Two documents that differ in one word, so that they share no window."""
    side = [f"w{i}" for i in range(60)]
    data = [(i, " ".join([*side[:30], w, *side[30:]]), "en", "s", 0) for i, w in enumerate(thue_morse(n))]
    got = result(repeats.remove_repeats(corpus.frame(spark, data), recompression.KIND))
    assert got == brute_words(data) and got[1][1] == 0
