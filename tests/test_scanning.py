"""Scanning, planning and local identities: pinned cases, empty tables, nulls."""

from codexa.functions import text as X
from codexa.operators import local, planning, scanning
from codexa.streaming import progress
from pyspark.sql import functions as F

FILES = "path string, album string, duration double"


def labels(spark, rows, folders=()):
    f = spark.createDataFrame(rows, FILES)
    names = f.select(scanning.parent_of(F.col("path")).alias("folder"))
    if folders:
        names = names.unionByName(spark.createDataFrame([(x,) for x in folders], "folder string"))
    return {r["path"]: (r["root"], r["label"]) for r in scanning.grouped(f, names).collect()}


def values(spark, f, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_walk(spark):
    paths = ["a.mp3", "_b.mp3", ".q/c.mp3", "_u/d.mp3", ".e.mp3", "x/.quarantine/f.mp3", "1/2/3/g.MP3", "1/2/3/4/h.mp3", "n.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in scanning.audio_files(df, "path", max_depth=3).collect()} == {"a.mp3", "_b.mp3", "_u/d.mp3", ".e.mp3", "1/2/3/g.MP3"}
    assert scanning.outside_quarantine(df, "path").count() == 8


def test_discs_collapse(spark):
    got = labels(spark, [("L/Book/CD1/a.mp3", "x", 1.0), ("L/Book/CD 2/a.mp3", "y", 1.0), ("L/T/Story Part 1/a.mp3", None, 1.0), ("L/Story of T/Story Part 1/a.mp3", None, 1.0)])
    assert got["L/Book/CD1/a.mp3"] == got["L/Book/CD 2/a.mp3"] == ("L/Book", "all")
    assert got["L/T/Story Part 1/a.mp3"] == ("L/T/Story Part 1", "rest") and got["L/Story of T/Story Part 1/a.mp3"] == ("L/Story of T", "all")
    # A sibling without audio is evidence too.
    assert labels(spark, [("L/T/Story Part 1/a.mp3", None, 1.0)], ["L/T/Story Part 2"])["L/T/Story Part 1/a.mp3"] == ("L/T", "all")


def test_albums_part(spark):
    rows = [("F/1.mp3", "Tale Disc 1", 1.0), ("F/2.mp3", "tale disc 2", 1.0), ("F/3.mp3", None, 1.0), ("F/4.m4b", None, None), ("F/5.mp3", " ", 3600.0)]
    got = {k: v[1] for k, v in labels(spark, rows).items()}
    assert got == {"F/1.mp3": "album:tale", "F/2.mp3": "album:tale", "F/3.mp3": "album:tale", "F/4.m4b": "file:F/4.m4b", "F/5.mp3": "file:F/5.mp3"}
    two = {k: v[1] for k, v in labels(spark, [*rows, ("F/6.mp3", "Other", 1.0)]).items()}
    assert two["F/3.mp3"] == "rest" and two["F/6.mp3"] == "album:other"
    assert labels(spark, [("F/1.mp3", None, 1.0), ("top.mp3", None, None)]) == {"F/1.mp3": ("F", "rest"), "top.mp3": ("", "rest")}
    empty = spark.createDataFrame([], FILES)
    assert scanning.grouped(empty, empty.select(F.col("path").alias("folder"))).count() == 0


def test_names(spark):
    guess = lambda c: X.name_guess(c, F.lit(False))
    got = values(spark, guess, "Brandon Sanderson - The Way of Kings", "Stormlight Archive Book 1", "AB12 - Title", "Dune [64k] (1965)", "", None)
    assert [tuple(r) for r in got[:4]] == [("The Way of Kings", "Brandon Sanderson", None, None), ("Stormlight Archive Book 1", None, "Stormlight Archive", "1"), ("Title", None, None, None), ("Dune", None, None, None)]
    assert [r["title"] if r else None for r in got[4:]] == [None, None]
    turned = values(spark, lambda c: X.name_guess(c, F.lit(True)), "On the Road - Jack Kerouac", "Jack Kerouac - On the Road")
    assert [(r["title"], r["author"]) for r in turned] == [("On the Road", "Jack Kerouac")] * 2
    assert values(spark, X.personal_name, "J.K. Rowling", "The Stand", "Jack", "Ann 2", "J. K.", None) == [True, False, False, False, False, False]
    assert values(spark, X.parent_author, "Kerouac, Jack", "05, Brown", "Jack Kerouac", None) == ["Kerouac, Jack", None, None, None]
    assert values(spark, X.fold, "ﬁlm ½ Ångström ＡＢ", "日本", "Žižek", None) == ["film 12 Angstrom AB", "", "Zizek", None]
    assert values(spark, X.author_list, "Brandon Sanderson", "A, B & C/D", "") == [["Br", "on S", "erson"], ["A", "B", "C", "D"], []]
    assert values(spark, lambda c: X.truncate(c, 10), "one two three", "onetwothree4", "short", "") == ["one two...", "onetwot...", "short", ""]


def test_numbers(spark):
    disc = lambda c: scanning.disc_number(c, F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert values(spark, disc, "CD1/a.mp3", "L/Disc 2/x/a.mp3", "a.mp3", "L/T Part 4/cd3.mp3", "Volume 9/a/b/c/d.mp3") == [1, 2, 1, 3, 1]
    tags = spark.createDataFrame([("7 x.mp3", {"TRCK": "3/9", "ASIN": "bad", "asin": "B012345678"}, 1.0), ("7 x.mp3", None, 1.0), ("7 x.mp3", {}, 1.0)], "path string, tags map<string,string>, duration double")
    assert [(r["track_index"], r["asin"], r["status"]) for r in scanning.track_rows(tags).collect()] == [(3, "B012345678", "valid"), (999, None, "error"), (7, None, "valid")]


def test_plans(spark):
    assert values(spark, lambda c: planning.escapes(c, "/lib"), "/lib/a", "/lib/../etc", "/library/x", "/lib", "/lib/a/../..") == [False, True, True, False, True]
    m = spark.createDataFrame([("p", "a", "X", "u"), ("p", "b", "x", "v"), ("q", "a", "X", "u"), ("q", "b", "x", "U"), ("r", "same", "same", "z")], "plan string, old_path string, t string, f string")
    got = {(r["plan"], r["old_path"]): (r["chosen"], r["n_conflicts"]) for r in planning.with_fallback(m, "plan", "t", "f").collect()}
    assert got == {("p", "a"): ("u", 0), ("p", "b"): ("v", 0), ("q", "a"): ("X", 1), ("q", "b"): ("x", 1)}
    assert planning.with_fallback(m.limit(0), "plan", "t", "f").count() == 0
    f = spark.createDataFrame([("/l/a/1", True), ("/l/a/b/2", True), ("/l/c/3", False), ("/l/c/d/4", True)], "path string, gone boolean")
    assert {r["folder"] for r in planning.emptied(f, "path", "gone", "/l").collect()} == {"/l/a", "/l/a/b", "/l/c/d"}
    s = spark.createDataFrame([(1, "On Combat Disc 1"), (1, "On Combat Disc 2"), (2, "It 1"), (2, "That 2"), (3, "Dune")], "g int, name string")
    assert dict(planning.segments(s, "g", "name", X.normalize_title).collect()) == {1: True, 2: False, 3: False}


def test_local(spark):
    i = spark.createDataFrame([("Title: A\nname: B\nWriter: X and Y\nauthors: Z\nnonsense",), ("",), (None,)], "t string").select(local.information(F.col("t")).alias("i"))
    rows = i.select("i.*", local.local_score(F.col("i")).alias("s")).collect()
    assert (rows[0]["title"], rows[0]["authors"], rows[0]["s"]) == ("B", ["X", "Y", "Z"], 0.9) and [round(r["s"], 2) for r in rows[1:]] == [0.2, 0.2]
    classes = local.alias_classes(spark.createDataFrame([("stephen king", "Richard Bachman"), ("A", "b"), ("B", "c")], "canonical string, alias string"))
    pairs = spark.createDataFrame([("stephen king", "richard bachman"), ("a", "c"), ("x", "x"), (None, "b")], "x string, y string")
    assert {(r["x"], r["y"]): r["alias"] for r in local.same_person(pairs, "x", "y", classes).collect()} == {("stephen king", "richard bachman"): True, ("a", "c"): False, ("x", "x"): False, (None, "b"): False}


def test_merge_stream_starts_again(spark, tmp_path):
    schema, place = "u int, at long, id long, v string", str(tmp_path / "out")
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in ([(1, 5, 1, "a"), (2, 5, 2, "a")], [(1, 5, 3, "late"), (2, 6, 4, "b"), (3, 1, 5, "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        got = progress.merge_stream(read(), "u", "at", "id", ["v"], place)
    assert {(r["u"], r["v"]) for r in got.collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_folders_tell_their_disc_once_a_folder(spark):
    paths = ["A/Tale Disc 2/x/y/1.mp3", "A/CD3/1.mp3", "A/CD3/deep/er/est/1.mp3", "1.mp3", "A/b/1.mp3", "far/CD 7/1.mp3"]
    files = spark.createDataFrame([(p, None, 1.0) for p in paths], "path string, album string, duration double")
    listed = files.filter("path NOT LIKE 'far%'").select(scanning.parent_of(F.col("path")).alias("folder"))
    none = F.lit(None).cast("string")
    g = scanning.grouped(files, listed).withColumn("alone", scanning.disc_number(F.col("path"), none, none))
    got = {r["path"]: (r["above"], r["alone"]) for r in g.collect()}
    assert [got[p] for p in paths] == [(2, 2), (3, 3), (None, 1), (None, 1), (None, 1), (7, 7)]
