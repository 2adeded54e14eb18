from codexa.operators import naming
from codexa.sources import documents, providers, sidecars
from pyspark.sql import functions as F


def test_provider_payloads(spark):
    docs = {
        "search_document": '{"key": "/works/OL1W", "title": "Dune", "author_name": ["F. H."], "isbn": ["0441172717", "9780441172719", "978-0-441-01359-3"], "first_publish_year": 1965, "language": ["eng"]}',
        "book_by_code": '{"title": "Dune", "authors": [{"name": "F. H."}], "narrators": [{"name": "N"}, {"name": "M"}], "seriesPrimary": [{"name": "Dune", "position": "1"}], "releaseDate": "2007-05-01", "runtimeLengthMin": 1262}',
        "volume": '{"volumeInfo": {"title": "Dune", "authors": ["F. H."], "publishedDate": "1990-09", "industryIdentifiers": [{"type": "ISBN_13", "identifier": "9780441172719"}], "categories": ["Fiction", "Dune series"]}}',
        "public_recording": '{"title": "Dune", "authors": [{"first_name": "F.", "last_name": "H."}], "copyright_year": "1965", "totaltimesecs": 3660, "sections": [{"readers": [{"display_name": "A"}]}, {"readers": [{"display_name": "A"}, {"display_name": "B"}]}]}',
    }
    for name, doc in docs.items():
        rows = getattr(providers, name)(spark.createDataFrame([(1, doc), (2, "[]"), (3, "not json"), (4, None)], "i int, j string"), "j").orderBy("i").collect()
        assert rows[0]["title"] == "Dune" and rows[0]["authors"] == ["F. H."] and all(r["title"] is None for r in rows[1:])
        want = {"search_document": ("9780441013593", 1965), "book_by_code": (None, 2007), "volume": ("9780441172719", 1990), "public_recording": (None, 1965)}[name]
        assert (rows[0]["isbn_13"], rows[0]["year"]) == want
    got = providers.public_recording(spark.createDataFrame([(docs["public_recording"],)], "j string"), "j").first()
    assert (got["narrator"], got["runtime_minutes"]) == ("A, B", 61)


def test_round_trips(spark):
    df = spark.createDataFrame([(1, "One", 0, 330000), (1, "T&wo", 330000, None)], "k int, title string, start_ms long, end_ms long")
    sheet = documents.cue_sheets(df, "k", "title", "start_ms", F.lit("a.m4b"))
    assert [(r["title"], r["start_ms"]) for r in sidecars.cue_tracks(sheet, "k", "text").orderBy("ord").collect()] == [("One", 0), ("T&wo", 330000)]
    text = documents.ffmetadata(df, "k", "title", "start_ms", "end_ms").first()["text"]
    assert text.startswith(";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=330000\ntitle=One\n")
    xml = spark.range(1).select(documents.opf(F.lit("A & <B>"), F.lit("C"), F.lit(None).cast("string"), F.lit("")).alias("x"))
    got = xml.select(*[c.alias(n) for n, c in sidecars.opf_fields(F.col("x")).items()]).first()
    assert (got["title"], got["creator"], got["language"], got["identifier"]) == ("A & <B>", "C", None, None)
    plan = documents.plan_documents(spark.createDataFrame([("p", 2, "b", "y"), ("p", 1, "a", "x")], "p string, i int, o string, n string"), "p", "i", "o", "n").first()
    assert plan["text"] == '{"plan":"p","operations":[{"old":"a","new":"x"},{"old":"b","new":"y"}]}'


def test_tables(spark, tmp_path):
    old, new = (spark.createDataFrame(r, "k string, at long, v string") for r in ([("a", 1, "x"), ("b", 5, "x"), ("c", 1, "x")], [("a", 2, "y"), ("b", 4, "y"), ("c", 1, "y"), ("d", 1, "y")]))
    assert {(r["k"], r["v"]) for r in documents.upsert(old, new, "k", "at").collect()} == {("a", "y"), ("b", "x"), ("c", "y"), ("d", "y")}
    for _ in range(2):
        documents.append_log(old, str(tmp_path / "log"), F.lit("2024-01-01"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6


def test_templates(spark):
    known = {"Author", "Series", "Title", "Track"}
    t = "{Author}/{Series} - {Title} ({Series})/{Track:3} - {Title}"
    assert naming.problems(t, known) == []
    assert naming.problems("{Author}/{Nope}<", known) == ["forbidden character", "unknown token Nope"] and naming.problems("{Author", known) == ["unbalanced braces"]
    df = spark.createDataFrame([("A/B", "S", "T?", 7), ("A", None, "T", None)], "Author string, Series string, Title string, Track int")
    got = [r[0] for r in df.select(naming.render(t, {c: F.col(c) for c in df.columns})).collect()]
    assert got == ["A/B/S - T? (S)/007 - T?", "A/T /T"]
    got = [r[0] for r in df.select(naming.folder_path(t, {c: F.col(c) for c in df.columns})).collect()]
    assert got == ["A/B/S - T_ (S)/007 - T_", "A/T/T"]
    # Empty square brackets and the spaces around slashes stay as they are; unknown tokens are blank.
    odd = df.limit(1).select(naming.render("[{Gone}] / {Author:x}{Nope} ( )", {"Author": F.lit("b"), "Gone": F.lit("")}), naming.track_name("{Title}", {"Title": F.lit("x" * 300 + "/" + "y")}, F.lit(".mp3")), naming.track_name("{Title}", {"Title": F.lit(" e\u0301t\u00e9.mp3 ")}, F.lit(".mp3"))).first()
    assert odd[0] == "[] / b" and odd[1] == "x" * 248 + "..." + ".mp3" and odd[2] == "\u00e9t\u00e9.mp3"


def test_template_names(spark):
    df = spark.range(1)
    full = naming.tokens(title=F.lit("the  LONG road"), author=F.lit("ann lee"), series=F.lit("saga"), series_index=F.lit(3), year=F.lit(1999), track=F.lit(7), most_track=F.lit(120), disc=F.lit(2), disc_count=F.lit(10), stem=F.lit("07 - on_the way"))
    bare = naming.tokens("as_is", title_guess=F.lit("x"), author=F.lit(" "), year=F.lit(None))
    get = lambda t: {k: v for k, v in df.select(*[c.alias(k) for k, c in t.items() if k in naming.SHORT_NAMES.values()]).first().asDict().items() if v}
    assert get(full) == {"Title": "The Long Road", "ShortTitle": "The Long Road", "Author": "Ann Lee", "AuthorLastFirst": "Lee, Ann", "SeriesName": "Saga", "SeriesIndex": "3", "Year": "1999", "Track": "7", "TrackPad": "007", "Disc": "2", "DiscPad": "02", "TrackTitle": "On The Way"}
    assert get(bare) == {"Title": "x", "ShortTitle": "x", "Author": "Unknown Author", "AuthorLastFirst": "Unknown Author"}
    assert len(full) == 31 and set(full) == set(bare)


def test_companions(spark):
    rows = [(1, 1, "CD1", "cover.jpg"), (1, 2, "CD2", "Cover.jpg"), (1, 3, "CD2", "cover.jpg"), (2, 1, "x", "notes")]
    got = {(r["book"], r["ord"]): r["new_name"] for r in naming.companions(spark.createDataFrame(rows, "book long, ord long, folder string, name string")).collect()}
    assert got == {(1, 1): "cover.jpg", (1, 2): "CD2 - Cover.jpg", (1, 3): "cover (2).jpg", (2, 1): "notes"}
