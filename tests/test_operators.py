"""Operators on small tables, ties and empty tables among them."""

import hashlib
import random

from codexa.operators import editions, files, matching, tracks
from codexa.sources import catalog, sidecars
from codexa.streaming import progress
import pytest
from pyspark.sql import functions as F


def naive_groups(rows):
    leader = {}
    rows = sorted(rows)
    for i, (o, title, author) in enumerate(rows):
        if o not in leader:
            leader[o] = o
            for p, other, writer in rows[i + 1 :]:
                if p not in leader and editions.similar_keys(title, author, other, writer):
                    leader[p] = o
    return leader


def test_greedy_is_not_transitive(spark):
    rows = [(1, "alpha beta gamma delta", ""), (2, "alpha beta gamma delta unabridged", ""), (3, "something else", ""), (4, "The Stand", "King"), (5, "The Stand", "Kong"), (6, "", ""), (7, "Stand The", "King"), (8, "unabridged", "")]
    keys = spark.createDataFrame(rows, "ord long, title string, author string")
    got = dict(editions.greedy_groups(keys, editions.similar_pairs(keys)).collect())
    assert got == naive_groups(rows) and got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 4, 8: 8}
    assert editions.greedy_groups(keys.limit(0), editions.similar_pairs(keys.limit(0))).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "a long, b long")
    assert dict(editions.greedy_groups(spark.range(1, 10).withColumnRenamed("id", "ord"), chain).collect()) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}


def test_candidates_lose_no_similar_pair(spark):
    """Typos, words put in, left out and turned round, short and repetitive titles: all pairs by comparison are found."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdehil") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    titles = set()
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        for _ in range(5):
            v = list(words)
            for _ in range(rng.randint(0, 2)):
                i, what = rng.randrange(len(v)), rng.randrange(4)
                if what == 0:
                    v[i] = v[i][: len(v[i]) // 2] + rng.choice("abxyz") + v[i][len(v[i]) // 2 :]
                elif what == 1:
                    v[i : i + 1] = [v[i][:3], v[i][3:]]
                elif what == 2:
                    v.insert(i, rng.choice(vocabulary))
                else:
                    rng.shuffle(v)
            titles.add(" ".join(x for x in v if x))
    titles |= {"a b c d e f g h", "a b c d e f g h i", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "foundation", "foundations"}
    rows = [(i, t, rng.choice(["", "king", "kings"])) for i, t in enumerate(sorted(titles, key=lambda _: rng.random()))]
    keys = spark.createDataFrame(rows, "ord long, title string, author string")
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if editions.similar_keys(*a[1:], *b[1:])}
    assert {tuple(r) for r in editions.similar_pairs(keys).collect()} == want and len(want) > 100
    assert dict(editions.greedy_groups(keys, editions.similar_pairs(keys)).collect()) == naive_groups(rows)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_match_scores(spark):
    """Every branch: equal, alias, best of several authors, series, year steps, levels, reasons, what is missing."""
    rows = [
        ("The Stand", "Stephen King", None, 1990, "Stand, The", ["Ann Lee", "King, Stephen"], None, 1990),
        ("The Stand", "Richard Bachman", "Dark", 1990, "stand", ["Stephen King"], "dark", 1988),
        ("It", "J.K. Rowling", "X", 1990, "That", ["Robert Galbraith", "Ann"], "Y", 1995),
        ("It", None, "", 0, "It", ["Ann"], "", 1995), ("It", "Ann", None, None, "It", [], None, None), ("It", "Ann Lee", None, 1990, "Other", ["Bob", "Anne Lee"], None, 1996),
        ("Café noir", "Lee, Ann Jr.", "The Saga", 2000, "Cafe Noir!", ["Joanne Rowling"], "Sagas", 2001),
    ]
    df = spark.createDataFrame(rows, "title string, author string, series string, year int, c_title string, c_authors array<string>, c_series string, c_year int")
    got = matching.match(df).collect()
    alike = lambda a, b: 200 * slow_lcs(a, b) / (len(a) + len(b)) / 100
    assert [round(r["author_score"], 3) for r in got][:5] == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert got[5]["author_score"] == pytest.approx(0.4 * alike("ann lee", "anne lee") + 0.4 * alike("ann lee", "anne lee") + 0.2 * max(alike("ann lee", w) for w in ("anne le", "nne lee", "anne l")))
    assert [r["title_score"] for r in got if r["title"] != "It"] == [1.0, 1.0, 1.0] and got[2]["title_score"] == pytest.approx(alike("it", "that"))
    assert [r["series_score"] for r in got][:4] == [0.0, 1.0, 0.0, 0.0] and got[6]["series_score"] == pytest.approx(alike("saga", "sagas"))
    assert [r["year_score"] for r in got] == [1.0, 0.7, 0.4, 0.0, 0.0, 0.0, 0.7]
    for r in got:
        assert r["confidence"] == pytest.approx(0.5 * r["title_score"] + 0.3 * r["author_score"] + 0.15 * r["series_score"] + 0.05 * r["year_score"])
        assert r["level"] == ("high" if r["confidence"] > 0.85 else "medium" if r["confidence"] > 0.65 else "low")
    assert got[1]["reasons"] == ["Excellent title match", "Author confirmed", "Series match"] and got[0]["reasons"] == ["Excellent title match", "Author confirmed", "Year match"]
    assert matching.match(df, {"Ann": ["Bob"], "stephen king": ["Ann Lee"]}).collect()[5]["author_score"] < 1 and matching.match(df.filter("title = 'The Stand' AND year = 1990 AND series IS NULL").withColumn("author", F.lit("ann lee")).withColumn("c_authors", F.array(F.lit("Richard Bachman"))), {"Stephen King": ["Ann Lee"]}).first()["author_score"] == 1.0


def test_edition_scores(spark):
    tracks = [("a", 1, 1, "mp3", 100, 60.5, 0), ("a", 1, 2, "M4B", None, 60.0, 0), ("b", 1, 1, "aac", 64, None, 1), ("b", 2, 1, "what", 0, 10.0, 0), ("c", 1, 1, "wav", 0, 5.0, 0), ("c", 1, 3, "wav", 0, 5.0, 0)]
    df = spark.createDataFrame(tracks, "book string, disc int, track_index int, format string, bitrate int, duration double, has_id int")
    got = {r["book"]: tuple(r)[1:] for r in editions.scores(df, "book", df.filter("book = 'b'").select("book")).collect()}
    assert got == {"a": (8, 0, 1, 0, 100, 120), "b": (2, 1, 1, 1, 64, 10), "c": (1, 0, 0, 0, 0, 10)}


def test_keepers_and_ties(spark):
    df = spark.createDataFrame([("g", 1, 320, 5), ("g", 2, 320, 9), ("g", 3, 64, 9), ("g", 4, 320, 9), (None, 5, 1, 1)], "g string, id int, rate int, len int")
    got = {r["id"]: (r["keeper"], r["reason"]) for r in editions.keepers(df, ["g"], ["rate", "len"], "id").collect()}
    assert got == {2: (2, None), 4: (2, "order"), 1: (2, "len"), 3: (2, "rate"), 5: (5, None)}


def test_votes(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, "x"), (2, "y"), (2, None), (3, "x"), (3, None), (4, None)], "k int, v string")
    assert dict(editions.majority(df, "k", "v").collect()) == {1: "x", 2: None, 3: "x", 4: None}
    assert editions.majority(df.limit(0), "k", "v").count() == 0


def test_tracks(spark):
    df = spark.createDataFrame([(1, 1, 600000), (1, 2, 600000), (1, 3, 0)], "k int, i int, ms long")
    rows = tracks.chapter_offsets(df, "k", ["i"], "ms").orderBy("i").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in rows] == [(0, 600000), (600000, 1200000), (1200000, None)]
    gaps = spark.createDataFrame([("A", "1"), ("a ", "3"), ("a", "x"), ("b", "1"), ("b", "2")], "s string, v string")
    assert [tuple(r) for r in tracks.series_gaps(gaps, "s", "v").collect()] == [("a", 2, "2")]
    order = spark.createDataFrame([(1, 1), (1, 1), (1, 4), (2, 1), (2, 2)], "k int, i int")
    assert {r["k"]: (r["has_duplicates"], r["missing"]) for r in tracks.order_issues(order, "k", "i").collect()} == {1: (True, "2,3"), 2: (False, "")}
    rates = spark.createDataFrame([(1, 128.0), (1, 128.0), (1, 320.0)], "k int, b double")
    assert tracks.outliers(rates, "k", "b").count() == 3
    quiet = spark.createDataFrame([(1, 10.0, 14.0), (1, 20.0, 25.0), (1, 100.0, 101.0), (1, 120.0, 130.0)], "k int, s double, e double")
    assert tracks.silence_breaks(quiet, "k", "s", "e", gap=10.0).first()["cuts"] == [12.0, 22.5, 125.0]
    # One that starts first and ends last has the later midpoint: the other comes first.
    nested = spark.createDataFrame([("a", 10.0, 60.0), ("a", 12.0, 18.0), ("a", 26.0, 29.0), ("a", None, 3.0)], "k string, s double, e double")
    assert tracks.silence_breaks(nested, "k", "s", "e", gap=10.0).first()["cuts"] == [15.0, 27.5]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name, body in (("a/x.mp3", b"1" * 200), ("a/_y.mp3", b"1" * 200), ("a/z.mp3", b"2" * 200), ("a/notes.doc", b"n"), ("a/cover.jpg", b"c"), (".hidden/q.mp3", b"q")):
        (tmp_path / name).write_bytes(body)
    df = catalog.catalogue(spark, [str(tmp_path)]).cache()
    assert {r["name"] for r in df.filter("NOT is_dir").collect()} == {"x.mp3", "_y.mp3", "z.mp3", "notes.doc", "cover.jpg"}
    assert [r["name"] for r in files.orphans(df.filter("NOT is_dir"), "path").collect()] == ["notes.doc"]
    hashes = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in catalog.hash_files(df.filter("NOT is_dir")).collect()}
    assert hashes["x.mp3"] == hashes["_y.mp3"] == hashlib.sha256(b"1" * 200).hexdigest() != hashes["z.mp3"]
    bytes_df = spark.createDataFrame([("x", 3, "aaa"), ("y", 3, "aaa"), ("z", 3, "aab"), ("w", 4, "aaaa")], "path string, size int, body string")
    assert {(r["path"], r["redundant"]) for r in files.byte_duplicates(bytes_df, "path", "size", "body", 1).collect()} == {("x", False), ("y", True)}


def test_roots(spark):
    items = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/q",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r["path"]: r["root"] for r in files.deepest_root(items, "path", roots, "root", "-").collect()} == {"/a/b/c": "/a/b", "/a/x": "/a", "/q": "-"}


def test_sidecars(spark):
    cue = 'FILE "x.mp3" MP3\n  TRACK 01 AUDIO\n    TITLE "One"\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    TITLE "Two"\n    INDEX 01 05:30:00\n  TRACK 03 AUDIO\n    INDEX 01 12:15:00\n'
    df = spark.createDataFrame([(1, cue)], "k int, t string")
    assert [(r["title"], r["start_ms"]) for r in sidecars.cue_tracks(df, "k", "t").orderBy("ord").collect()] == [("One", 0), ("Two", 330000), (None, 735000)]
    docs = ['{"series": []}', '{"series": [{"name": "S"}]}', '{"series": 7}', '{"series": {"name": "T"}}', '{"series": ["U"]}', "not json", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    assert [r[0] for r in df.orderBy("i").select(sidecars.loose_text(F.col("j"), "$.series")).collect()] == [None, "S", "7", "T", "U", None, None]
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Dune</dc:title><creator>Frank Herbert</creator></metadata></package>'
    got = spark.createDataFrame([(opf,)], "x string").select(*[c.alias(n) for n, c in sidecars.opf_fields(F.col("x")).items()]).first()
    assert (got["title"], got["creator"], got["date"]) == ("Dune", "Frank Herbert", None)


def test_providers(spark):
    rows = [("k", 0, "p", "Title", "", 0, 0.8), ("k", 1, "q", "Other", "Narr", 960, 0.7), ("s", 0, "p", "T", None, None, 0.5)]
    df = spark.createDataFrame(rows, "k string, prio int, provider string, title string, narrator string, runtime int, conf double")
    got = {r["k"]: r for r in matching.backfill(df, "k", "prio", ["title", "narrator", "runtime"], "provider", "conf").collect()}
    assert (got["k"]["title"], got["k"]["narrator"], got["k"]["runtime"], got["k"]["providers"]) == ("Title", "Narr", 960, ["p", "q"])
    assert abs(got["k"]["confidence"] - 0.87) < 1e-9 and got["s"]["confidence"] == 0.5
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert {tuple(r) for r in matching.ladder([a, b], "k", "v").select("k", "v", "rung").collect()} == {(1, "x", 0), (2, "z", 1)}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(u, t, i, float(i)) for i, (u, t) in enumerate([(1, 5), (1, 9), (2, 3), (1, 9), (2, 1)])]
    df = spark.createDataFrame(rows, "u int, at long, id long, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = progress.stream_latest(stream, "u", "at", "id", ["v"], "latest_progress", str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = {tuple(r) for r in progress.latest(df, "u", "at", "id", ["v"]).collect()}
    assert {tuple(r) for r in spark.table("latest_progress").collect()} == want == {(1, 9, 1.0), (2, 3, 2.0)}


def test_merge_is_strict(spark):
    ours, theirs = (spark.createDataFrame(r, "u int, at long, v string") for r in ([(1, 5, "a"), (2, 5, "a")], [(1, 5, "b"), (2, 6, "b"), (3, 1, "b")]))
    assert {(r["u"], r["v"]) for r in progress.merge(ours, theirs, "u", "at", ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "b")}


def test_stream_daily_counts_files_in_any_order(spark, tmp_path):
    from codexa.plans import streams

    days = [5, 1, 9, 3, 1, 5]
    for i, day in enumerate(days):
        rows = [(i * 10 + k, f"2024-01-{day:02} 0{k}:00:00", 1, ["view", "buy"][k % 2], 1.0) for k in range(4)]
        events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        events.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {(r["day_start"].day, r["event_type"]): r["n"] for r in streams.stream_daily(spark, str(tmp_path)).collect()}
    assert got == {(day, kind): 2 * days.count(day) for day in days for kind in ("view", "buy")}
