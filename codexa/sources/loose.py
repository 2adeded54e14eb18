"""Loosely typed JSON sidecars: a field's value whatever it is written as.

Values are VARIANTs and told apart by ``schema_of_variant``.  A field's candidates
start with its value; an object is replaced by what its naming keys hold, a list by
its items, level by level and in their order, and the first that is a text or a
number counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, let

# The keys under which an object holds what it stands for, first ones first.
NAMING = ("name", "title", "value", "series")
#: The first whole number of a text.
WHOLE = r"-?\d+"
#: Levels of objects and lists that a value may lie under.
LEVELS = 6
#: Fields of an identity by the key of a sidecar, and how each is read.
FIELDS = {
    "title": "title", "authors": "authors", "series": "series", "series_index": "seriesIndex", "year": "year", "language": "language", "narrator": "narrator",
    "publisher": "publisher", "isbn": "isbn", "asin": "asin", "description": "description", "cover_url": "coverUrl",
}


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def items(v: Column) -> Column:
    """A list's items."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _deeper(candidates: Column) -> Column:
    named = lambda v: F.array(*[F.try_variant_get(v, f"$.{k}", "variant") for k in NAMING])
    return F.flatten(F.transform(candidates, lambda v: F.when(_is(v, "OBJECT"), named(v)).when(_is(v, "ARRAY"), items(v)).otherwise(F.array(v))))


def _plain(v: Column) -> Column:
    """A text without outer blanks, or a number as text; a whole number that is written with a point keeps one."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    pointed = kind.rlike(r"^DECIMAL\((?:[1-9]|1[0-8]),0\)$")
    number = F.when(pointed, F.concat(text, F.lit(".0"))).when(kind.rlike("^(?:BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), text)
    return F.when(kind == "STRING", blank_to_null(text)).otherwise(number)


def scalar(v: Column) -> Column:
    """The first text or number that a value holds; null for true, false, null and what holds none."""

    def held(v):
        found = F.array(v)
        for _ in range(LEVELS):
            found = _deeper(found)
        return F.try_element_at(F.filter(F.transform(found, _plain), lambda x: x.isNotNull()), F.lit(1))

    return let(v, lambda x: F.when(_is(x, "OBJECT") | _is(x, "ARRAY"), held(x)).otherwise(_plain(x)))


def strings(v: Column) -> Column:
    """Each item of a list as a text, those that hold none left out; anything else as a list of one."""
    each = F.when(_is(v, "ARRAY"), items(v)).otherwise(F.array(v))
    return F.filter(F.transform(each, scalar), lambda x: x.isNotNull())


def identity(json: Column) -> Column:
    """struct(title, authors, series, series_index, year, language, narrator, publisher, isbn_10, isbn_13, asin, description, cover_urls); null without a title or an object."""

    keys = [k for k in FIELDS if k != "authors"]
    none = F.array().cast("array<string>")

    def read(v):
        """Each field's value, all by one expression, and the list of authors."""
        at = lambda key: F.try_variant_get(v, f"$.{FIELDS[key]}", "variant")
        return F.struct(F.transform(F.array(*[at(k) for k in keys]), scalar).alias("one"), strings(at("authors")).alias("authors"))

    def made(found):
        get = lambda key: found["one"][keys.index(key)]
        code = F.regexp_replace(F.upper(get("isbn")), "[^0-9X]", "")
        year = F.nullif(F.regexp_extract(get("year"), WHOLE, 0), F.lit("")).try_cast("long")
        return F.struct(
            get("title").alias("title"), found["authors"].alias("authors"), *[get(n).alias(n) for n in ("series", "series_index")], year.alias("year"), *[get(n).alias(n) for n in ("language", "narrator", "publisher")],
            *[F.when(F.length(code) == n, code).alias(f"isbn_{n}") for n in (10, 13)], *[get(n).alias(n) for n in ("asin", "description")], F.coalesce(F.array_compact(F.array(get("cover_url"))), none).alias("cover_urls"),
        )

    known = let(F.try_parse_json(json), lambda v: F.when(_is(v, "OBJECT"), read(v)))
    return let(known, lambda found: F.when(found["one"][0].isNotNull(), made(found)))


def document(i: Column) -> Column:
    """An identity as a sidecar: the long code or else the short one, the first cover; what is blank is left out, but for title and authors."""
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    year = F.nullif(i["year"], F.lit(0).cast("long"))
    code = F.coalesce(some(i["isbn_13"]), some(i["isbn_10"]))
    fields = {"title": i["title"], "authors": i["authors"], "series": some(i["series"]), "seriesIndex": some(i["series_index"]), "narrator": some(i["narrator"]), "year": year, "isbn": code,
              "asin": some(i["asin"]), "description": some(i["description"]), "publisher": some(i["publisher"]), "language": some(i["language"]), "coverUrl": F.try_element_at(i["cover_urls"], F.lit(1))}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "true"})


