"""Loose JSON and package documents, against readers of their own."""

import json
import random
import re
import xml.etree.ElementTree as ET

from codexa.sources import loose, packages
from pyspark.sql import functions as F

BLANK = " \t\n"


def value_of(v):
    """A reading by rules: texts, numbers, the naming keys of objects, items of lists."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str):
        return v.strip() or None
    if isinstance(v, (int, float)):
        return str(v)
    inner = [v.get(k) for k in loose.NAMING] if isinstance(v, dict) else v
    return next((x for x in map(value_of, inner) if x is not None), None)


def made(rng, depth=0):
    pick = rng.randint(0, 9 if depth < 3 else 6)
    if pick < 7:
        return rng.choice(["text", "  padded ", "", " ", 7, 2.5, 3.0, True, False, None, "2013-05", -4, "é", 12345678901])
    if pick == 7:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["name", "title", "value", "series", "other"]): made(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def test_values_of_every_shape(spark):
    rng = random.Random(6)
    docs = [{k: made(rng) for k in rng.sample(list(loose.FIELDS.values()), 8)} | ({"title": made(rng)} if rng.random() < 0.8 else {}) for _ in range(300)]
    texts = [json.dumps(d, ensure_ascii=False) for d in docs] + ["[1]", "nope", "", None, '"title"', '{"title": "cut']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", loose.identity(F.col("t")).alias("d")).collect()
    for i, d in got:
        doc = docs[i] if i < len(docs) else {}
        title = value_of(doc.get("title"))
        assert (d is None) == (title is None), texts[i]
        if d is None:
            continue
        names = doc.get("authors")
        listed = [x for x in map(value_of, names if isinstance(names, list) else [names]) if x is not None]
        assert (d["title"], d["authors"]) == (title, listed), texts[i]
        for field in ("series", "series_index", "language", "narrator", "publisher", "asin", "description"):
            assert d[field] == value_of(doc.get(loose.FIELDS[field])), (field, texts[i])
        year = re.search(r"-?\d+", value_of(doc.get("year")) or "")
        assert d["year"] == (int(year[0]) if year else None)
        cover = value_of(doc.get("coverUrl"))
        assert d["cover_urls"] == ([cover] if cover else [])


def test_written_sidecars(spark):
    rows = [("T", ["A", "B"], "", "1", 0, "123456789X", None, ["u", "v"]), ("T", [], "S", None, 1999, "123456789X", "9780000000000", [])]
    df = spark.createDataFrame(rows, "title string, authors array<string>, series string, series_index string, year long, isbn_10 string, isbn_13 string, cover_urls array<string>")
    i = F.struct(*df.columns, *[F.lit(None).cast("string").alias(n) for n in ("narrator", "asin", "description", "publisher", "language")])
    got = [json.loads(r[0]) for r in df.select(loose.document(i)).collect()]
    assert got == [{"title": "T", "authors": ["A", "B"], "seriesIndex": "1", "isbn": "123456789X", "coverUrl": "u"}, {"title": "T", "authors": [], "series": "S", "year": 1999, "isbn": "9780000000000"}]


def read(xml):
    """By an element tree, with namespaces."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    dc, opf = f"{{{packages.DC}}}", f"{{{packages.OPF}}}"
    m = root.find(opf + "metadata")
    m = root.find("metadata") if m is None else m
    if m is None:
        return None
    text = lambda n: next((e.text.strip() for e in (m.find(dc + n), m.find(n)) if e is not None and e.text), None)
    if not text("title"):
        return None
    people = [e for e in m.findall(dc + "creator") if e.text] or [e for e in m.findall("creator") if e.text]
    isbn, asin = {}, None
    for e in m.findall(dc + "identifier"):
        scheme, code = e.get(opf + "scheme", "").upper(), (e.text or "").strip()
        if scheme in ("ISBN", "ISBN13"):
            isbn[len(re.sub("[^0-9X]", "", code.upper()))] = re.sub("[^0-9X]", "", code.upper())
        elif scheme == "ASIN":
            asin = code
    pairs = {e.get("name"): e.get("content", "") for e in [*m.findall(opf + "meta"), *m.findall("meta")]}
    year = re.search(r"\b(19|20)\d{2}\b", text("date") or "")
    return (text("title"), [e.text.strip() for e in people], [e.get(opf + "role") for e in people], pairs.get("calibre:series"), pairs.get("calibre:series_index"), int(year[0]) if year else None,
            text("language"), pairs.get("calibre:narrator"), text("publisher"), isbn.get(10), isbn.get(13), asin, text("description"))


def package(rng):
    dc, opf = rng.choice(["dc", "dc", "d", ""]), rng.choice(["", "", "opf", "o", None])
    e, o = f"{dc}:" if dc else "", f"{opf}:" if opf else ""
    spaces = (f' xmlns:{dc}="{packages.DC}"' if dc else "") + (f' xmlns:{opf}="{packages.OPF}"' if opf else "") + (f" xmlns='{packages.OPF}'" if opf == "" else "") + ("" if opf else f' xmlns:opf="{packages.OPF}"')
    mark = o or "opf:"
    some = lambda *xs: rng.choice(["", *xs, *xs])
    parts = [
        some(f"<{e}title id='t'>The &amp; <![CDATA[Title]]></{e}title>", f"<{e}title> One </{e}title><{e}title>Two</{e}title>"), some(f'<{e}creator {mark}role="aut" {mark}file-as="x">Ann</{e}creator>'), some(f"<{e}creator> Bo </{e}creator><{e}creator/>"),
        some(f"<{e}language>en</{e}language>"), some(f"<{e}date>2011-05-01T00:00</{e}date>", f"<{e}date>12011</{e}date>"), some(f"<{e}publisher>P</{e}publisher>"), some(f"<{e}description>a\n b</{e}description>"),
        some(f'<{e}identifier {mark}scheme="isbn">978-0-00-000000-2</{e}identifier>'), some(f'<{e}identifier {mark}scheme="ISBN13">0-00-000000-x</{e}identifier>', f'<{e}identifier scheme="ISBN">9780000000002</{e}identifier>'),
        some(f'<{e}identifier {mark}scheme="Asin"> B000000001 </{e}identifier>'), some(f'<{o}meta name="calibre:series" content="S"/><{o}meta name="calibre:series" content="S2"/>'), some(f'<{o}meta name="calibre:series_index" content="1.5"/>'),
        some(f'<{o}meta content="N" name="calibre:narrator"/>'), some(f"<{o}meta property='x'>text</{o}meta>"),
    ]
    rng.shuffle(parts)
    whole = f"<?xml version='1.0'?>\n<{o}package{spaces} version='2.0'><{o}metadata>{''.join(parts)}</{o}metadata></{o}package>"
    return whole[: rng.randint(1, len(whole))] if rng.random() < 0.1 else whole


def test_packages_equal_an_element_tree(spark):
    rng = random.Random(8)
    docs = [package(rng) for _ in range(300)] + ["", "<x/>", "<package/>", "words", "<package><metadata><title>Bare</title><creator>Cy</creator></metadata></package>"]
    got = spark.createDataFrame([*enumerate(docs), (900, None)], "i int, x string").select("i", packages.identity(F.col("x")).alias("d")).collect()
    found = 0
    for i, d in got:
        want = read(docs[i]) if i < len(docs) else None
        assert (None if d is None else tuple(d)) == want, docs[i]
        found += want is not None
    assert found > 100
