"""Pinned values of the name, number and similarity functions."""

import random
import unicodedata

import pytest
from codexa.functions import similarity as S
from codexa.functions import text as X
from codexa.operators import matching
from pyspark.sql import functions as F


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_titles(spark):
    assert values(spark, X.normalize_title, "The Lord of the Rings", "A Game of Thrones", "An Example Title", "Stand, The", "Café", None) == [
        "lord of the rings", "game of thrones", "example title", "stand", "cafe", None]


def test_authors(spark):
    assert values(spark, X.normalize_author, "King, Stephen", "Stephen King", "Martin Luther King Jr.") == ["stephen king", "stephen king", "martin luther king"]


def test_series(spark):
    got = values(spark, X.series_of, "Mistborn Book 1", "Stormlight #4", "Foo Part 2", "Just a Title")
    assert [tuple(g) if g else None for g in got] == [("Mistborn", "1", 0.95), ("Stormlight", "4", 0.9), ("Foo", "2", 0.85), None]


def test_numbers(spark):
    texts = ["01 Chapter One", "001 Introduction", "23 The Adventure", "99_final_chapter", "Track 05 - Something", "Chapter 12", "Part 3 - The End"]
    assert values(spark, lambda c: X.first_int(c, *X.TRACK_PATTERNS), *texts) == [1, 1, 23, 99, 5, 12, 3]
    assert values(spark, lambda c: X.first_int(c, X.DISC_PATTERN), "CD1", "Disc 2", "Book 3", "Volume 4", "Extras") == [1, 2, 3, 4, None]
    assert values(spark, X.runtime_minutes, "16 hrs and 12 mins", "45 mins", "soon") == [972, 45, None]


def test_identifiers(spark):
    assert values(spark, X.valid_isbn, "0451524934", "080442957X", "9780451524935", "12345", "abcdefghij", "123456789012", "") == [True] * 3 + [False] * 4
    assert values(spark, X.valid_asin, "B0ABCDEFGH", "B012345678", "b0abcdefgh", "1234567890", "B1ABCDEFGH", "B0ABCDEF", "") == [True] * 3 + [False] * 4


def test_names(spark):
    assert values(spark, X.last_first, "Brandon Sanderson", "J.K. Rowling", "Madonna", "Jean-Claude Van Damme") == ["Sanderson, Brandon", "Rowling, J.K.", "Madonna", "Damme, Jean-Claude Van"]
    assert values(spark, X.file_name, "File/with\\forbidden:chars.mp3") == ["File_with_forbidden_chars.mp3"]
    assert values(spark, X.title_case, "the way  of kings") == ["The Way Of Kings"]
    assert values(spark, lambda c: X.split_dash(c, 1), "Brandon Sanderson - The Way of Kings", "Dune") == ["Brandon Sanderson", None]
    assert values(spark, X.shorten, "one two three four five six seven eight", "") == ["one two three four five six", ""]


def test_similarity():
    assert S.ratio("", "") == 100 and S.ratio("abc", "") == 0 and S.ratio("abcd", "abxd") == 75
    assert S.token_sort_ratio("king stephen", "stephen king") == 100
    assert S.token_set_ratio("the stand", "the stand unabridged") == 100 and S.token_set_ratio("", "x") == 0
    assert S.partial_ratio("stand", "the stand unabridged") == 100
    rows = [(a, b) for a in ("", "a", "abca", "xyz") for b in ("abc", "caba", "zyx")]
    assert all(S.lcs(a, b) == S.lcs(b, a) <= min(len(a), len(b)) for a, b in rows)


def test_match(spark):
    df = spark.createDataFrame([("The Stand", "King, Stephen", 1978, "Stand, The", ["Stephen King"], 1978), ("The Stand", "King, Stephen", None, "It", ["Dan Brown"], 1978)], "title string, author string, year int, c_title string, c_authors array<string>, c_year int").withColumns({"series": F.lit(None).cast("string"), "c_series": F.lit(None).cast("string")})
    good, bad = matching.match(df).orderBy(F.desc("confidence")).collect()
    assert good["confidence"] > 0.85 and good["level"] == "high" and good["reasons"] == ["Excellent title match", "Author confirmed", "Year match"]
    assert bad["level"] == "low"


@pytest.mark.parametrize(("policy", "want"), [("overwrite", ["n", "n", "o"]), ("fill_missing", ["o", "n", "o"]), ("preserve", ["o", None, "o"])])
def test_policy(spark, policy, want):
    df = spark.createDataFrame([(0, "o", "n"), (1, "", "n"), (2, "o", "")], "i int, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(matching.write_policy(F.col("a"), F.col("b"), policy)).collect()] == want


def test_unicode(spark):
    """White space of any kind, composition, ligatures and long names."""
    assert values(spark, X.normalize_title, "\tThe Stand\xa0", "The\u3000Stand", "ﬁre \u2003 Ænima", "Stand,\u2009the\x1f") == ["stand", "stand", "fire nima", "stand"]
    assert values(spark, X.normalize_author, "\xa0King, Stephen jr.\u2028") == ["stephen king"]
    assert values(spark, X.composed, "e\u0301te\u0301", "a\u0323\u0302", "plain", "x\u0301") == [unicodedata.normalize("NFC", t) for t in ("e\u0301te\u0301", "a\u0323\u0302", "plain", "x\u0301")]
    long = values(spark, X.file_name, "n" * 300 + ".mp3", "word " * 80 + ".flac", "x" * 255, ".hidden" * 60)
    assert [len(n) for n in long][0] == 255 and long[0].endswith("n....mp3") and long[1].endswith("word....flac") and long[2] == "x" * 255 and len(long[3]) <= 255
    assert values(spark, X.runtime_minutes, "16 hrs and 12 mins", "3 hours", "3 hr", "45 minutes", "") == [972, None, 180, 45, None]
    assert values(spark, X.shorten, "short   one", "one two three four five six seven", "x" * 40, " " * 31, "a" * 30 + " b") == ["short   one", "one two three four five six", "x" * 30, " " * 30, "a" * 30]


def test_tags(spark):
    """The order of keys, codes in text and links, numbers in text."""
    from codexa.operators import scanning

    def fields(tags):
        df = spark.createDataFrame([(tags,)], "t map<string,string>")
        return {k: v for k, v in df.select(*[c.alias(k) for k, c in scanning.tag_fields(F.col("t")).items()]).first().asDict().items() if v is not None}

    assert fields({"\xa9nam": "mp4", "TITLE": "vorbis", "title": "x"}) == {"title": "vorbis"}
    assert fields({"TXXX:ASIN": "none", "TXXX:AUDIBLE_ASIN": "b012345678", "CDEK": "B099999999"}) == {"asin": "B012345678"}
    assert fields({"CDEK": "see B099999999, ok"}) == {"asin": "B099999999"} and fields({"WXXX:a": "https://x/pd/b0aaaaaaaa?q"}) == {"asin": "B0AAAAAAAA"}
    assert fields({"TRCK": "none", "TRACKNUMBER": "03/12", "disk": "2", "TPE2": " A ", "TCOM": "R", "ISBN": "978-3-16-148410-0", "TXXX:ISBN": "12"}) == {"track": "03", "disc": "2", "albumartist": "A", "narrator": "R", "isbn": "9783161484100"}
    assert fields({"disc": "9", "track": "3", "isbn": "9783161484100"}) == {}


def test_normal_forms_of_every_character(spark):
    """Composition and folding equal the standard's, alone and behind a base, for all characters that this Python knows."""
    known = [chr(n) for n in range(1, 0x110000) if not 0xD800 <= n < 0xE000 and unicodedata.category(chr(n)) != "Cn"]
    rows = ["".join(known[i : i + 64]) for i in range(0, len(known), 64)] + ["".join("e" + c for c in known[i : i + 64]) for i in range(0, len(known), 64)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", X.composed(F.col("t")), X.fold(F.col("t"))).collect()
    for i, nfc, folded in got:
        assert nfc == unicodedata.normalize("NFC", rows[i])
        assert folded == unicodedata.normalize("NFKD", rows[i]).encode("ascii", "ignore").decode()


def test_normal_forms_of_marks_in_any_order(spark):
    rng = random.Random(4)
    marks = [chr(n) for n in range(0x300, 0x370)] + ["\u1161", "\u11a8", "\u3099", "\u0f71"]
    bases = ["a", "e", "o", "\u1100", "\uac00", "\u304b", "\u00ea", "x"]
    texts = ["".join(rng.choice(bases) + "".join(rng.sample(marks, rng.randint(0, 4))) for _ in range(3)) for _ in range(2000)]
    assert values(spark, X.composed, *texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_arrays_of_authors(spark):
    rows = [(1, ["Müller, Ann Jr.", None, "", "Žižek"]), (2, []), (3, None), (4, ["x"])]
    df = spark.createDataFrame(rows, "i int, t array<string>").repartition(1)
    want = {i: None if t is None else [None if n is None else values(spark, X.normalize_author, n)[0] for n in t] for i, t in rows}
    assert {r["i"]: r["v"] for r in df.select("i", X.normalize_authors(F.col("t")).alias("v")).collect()} == want
    assert {r["i"]: r["v"] for r in df.filter("i > 1").select("i", X.normalize_authors(F.col("t")).alias("v")).collect()} == {k: v for k, v in want.items() if k > 1}
