"""Orders of moves, compared snapshots and a server's answers."""

import json
import random

from codexa.operators import renames, snapshots
from codexa.sources import server


def plan(rng, n):
    """Moves among names, of which some are files already; sources and targets are unique."""
    names = [f"/l/{i}" for i in range(n)]
    olds = rng.sample(names, rng.randint(1, n))
    news = rng.sample(names + [f"/new/{i}" for i in range(n)], len(olds))
    return [(o, w) for o, w in zip(olds, news, strict=True) if o != w], set(olds) | set(rng.sample(names, n // 4))


def test_moves_are_made_without_overwriting(spark):
    rng = random.Random(2)
    plans = {f"p{i}": plan(rng, rng.choice([2, 3, 5, 12])) for i in range(40)}
    # A long chain, a long cycle, and two names that change places.
    plans["chain"] = ([(f"/c/{i}", f"/c/{i + 1}") for i in range(300)], {f"/c/{i}" for i in range(300)})
    plans["cycle"] = ([(f"/c/{i}", f"/c/{(i + 1) % 101}") for i in range(101)], {f"/c/{i}" for i in range(101)})
    plans["swap"] = ([("/a", "/b"), ("/b", "/a")], {"/a", "/b"})
    moves = spark.createDataFrame([(k, o, w) for k, (m, _) in plans.items() for o, w in m] + [("same", "/x", "/x")], "plan string, old string, new string")
    files = spark.createDataFrame([(k, f) for k, (_, fs) in plans.items() for f in fs], "plan string, path string")
    steps: dict = {}
    for r in renames.ordered(moves.repartition(3), files).collect():
        steps.setdefault(r["plan"], []).append(r)
    assert "same" not in steps
    for name, (wanted, there) in plans.items():
        content, blocked, turns = {f: f for f in there}, set(), 0
        own = sorted(steps.get(name, []), key=lambda r: (r["step"], r["chain"]))
        for r in own:
            if r["blocked"]:
                blocked.add(r["source"])
                continue
            assert r["target"] not in content and r["source"] in content, (name, r)
            content[r["target"]] = content.pop(r["source"])
            turns += r["kind"] == "aside"
        done = {o: w for o, w in wanted if o not in blocked}
        stuck = {o for o in dict(wanted) if o in blocked}
        assert content == {**{f: f for f in there if f not in done}, **{w: o for o, w in done.items()}}
        # Blocked are those, and only those, whose wait ends on a file that stays.
        to = dict(wanted)
        for o in to:
            at, seen = to[o], {o}
            while at in to and at not in seen:
                seen.add(at)
                at = to[at]
            assert (o in stuck) == (at in there and at not in to), (name, o)
        assert turns == (name in ("cycle", "swap")) or name.startswith("p")


def test_empty_plan(spark):
    none = spark.createDataFrame([], "plan string, old string, new string")
    assert renames.ordered(none, spark.createDataFrame([], "plan string, path string")).count() == 0


def test_rows_that_have_arrived_are_not_doubled_again(spark, monkeypatch):
    seen, real = [], renames.cut

    def counted(df):
        done = real(df)
        seen.append(done.count())
        return done

    monkeypatch.setattr(renames, "cut", counted)
    single, ring = [("a", f"/s/{i}", f"/t/{i}") for i in range(100)], [("b", f"/c/{i}", f"/c/{(i + 1) % 64}") for i in range(64)]
    moves = spark.createDataFrame(single + ring, "plan string, old string, new string")
    assert renames.ordered(moves, moves.selectExpr("plan", "old AS path")).count() == 165
    assert sum(seen) <= 2 * 164 + 9 * 64


def full_comparison(a, b):
    out, gone, come = {}, {}, {}
    for p in a.keys() | b.keys():
        if p not in b:
            gone.setdefault((p.rsplit("/", 1)[1], a[p]), []).append(p)
        elif p not in a:
            come.setdefault((p.rsplit("/", 1)[1], b[p]), []).append(p)
        elif a[p] != b[p]:
            out[p] = ("changed", None)
    for k in gone.keys() | come.keys():
        g, c = gone.get(k, []), come.get(k, [])
        if len(g) == len(c) == 1:
            out[c[0]] = ("moved", g[0])
        else:
            out |= {p: ("vanished", None) for p in g} | {p: ("added", None) for p in c}
    return out


def test_changes_equal_a_full_comparison(spark):
    rng = random.Random(3)
    a = {f"/lib/{rng.randint(0, 9)}/{rng.choice('xyz')}/{i}.mp3": (i, rng.randint(0, 3)) for i in range(300)} | {"/lib/top.txt": (1, 1), "/other/deep/er/f": (2, 2)}
    b = dict(a)
    for p in rng.sample(sorted(a), 20):
        b.pop(p)
    for p in rng.sample(sorted(b), 20):
        b[p] = (b[p][0] + 1, b[p][1])
    for p in rng.sample(sorted(b), 20):
        b[p.replace("/lib/", "/lib/moved/")] = b.pop(p)
    b |= {f"/lib/new/{i}.mp3": (i, 9) for i in range(5)} | {"/lib/1/twin": (5, 5), "/lib/2/twin": (5, 5)}
    frame = lambda d: spark.createDataFrame([(p, s, m) for p, (s, m) in d.items()], "path string, size long, modified long").repartition(3)
    got = {r["path"]: (r["kind"], r["moved_from"]) for r in snapshots.changes(frame(a), frame(b)).collect()}
    assert got == full_comparison(a, b) and {k for k, _ in got.values()} == {"added", "changed", "moved", "vanished"}
    listed = {r["folder"] for r in snapshots.to_list(snapshots.digests(frame(a)), snapshots.digests(frame(b))).filter("relist").collect()}
    assert listed == {p.rsplit("/", 1)[0] for p in a.keys() | b.keys() if a.get(p) != b.get(p)}
    assert snapshots.changes(frame(a), frame(a)).count() == 0


def test_answers(spark):
    item = {"id": "i1", "media": {"metadata": {"title": "T", "authorName": "A"}}}
    docs = [
        ("libraries", {"libraries": [{"id": "l1", "name": "L"}]}), ("libraries", [{"id": "l2", "name": "M"}, 5]), ("items", {"results": [item, {"id": "i2", "title": "U"}], "total": 40}), ("items", [item]), ("search", {"book": [{"libraryItem": item}, item]}),
        ("search", {"books": [item]}), ("item", item), ("progress", {"libraryItemId": "i1", "progress": 0.5, "currentTime": 60, "isFinished": False, "lastUpdate": 17}), ("collections", [{"id": "c", "name": "C", "books": [1, 2]}]), ("collections", {"collections": []}),
        ("stats", {"totalTime": 7200, "days": {"a": 1, "b": 2}, "recentSessions": [1]}), ("stats", {}), ("items", {"results": "none"}), ("item", "text"), ("item", None),
    ]
    rows = [(i, e, json.dumps(d)) for i, (e, d) in enumerate(docs)] + [(90, "item", "broken"), (91, "items", None)]
    got = {(r["k"], r["place"]): tuple(r)[3:] for r in server.answers(spark.createDataFrame(rows, "k int, e string, j string"), ["k"], "e", "j").collect()}
    t = ("i1", "T", "A", None, None, None, None, None)
    none = (None,) * 9
    assert got == {
        (0, 0): ("l1", "L", *none[:7]), (1, 0): ("l2", "M", *none[:7]), (2, 0): (*t, 40), (2, 1): ("i2", "U", *none[:6], 40), (4, 0): (*t, None), (4, 1): (*t, None), (5, 0): (*t, None), (6, 0): (*t, None),
        (7, 0): ("i1", None, None, 0.5, 60.0, False, "17", None, None), (8, 0): ("c", "C", *none[:5], 2, None), (10, 0): (*none[:4], 7200.0, None, None, 2, 1), (11, 0): (*none[:7], 0, 0),
    }
