"""Package documents (OPF): Dublin Core elements and their attributes, identifiers by scheme, and calibre's name and content pairs.

Elements are told apart by namespace, whatever their prefixes: a first step writes the
prefixes that a document declares as ``dc`` and ``opf``, and one ``from_xml`` reads
arrays of elements with their attributes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import YEAR, let, strip

# Namespaces, calibre's names, and the schemes that mean a code.
DC, OPF = "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/opf"
CALIBRE = {"series": "calibre:series", "series_index": "calibre:series_index", "narrator": "calibre:narrator"}
ISBN_SCHEMES, ASIN_SCHEME = ("ISBN", "ISBN13"), "ASIN"

_TEXTS = ("title", "creator", "language", "description", "publisher", "date")
_ELEMENT = "array<struct<_VALUE: string, `_opf:role`: string, `_opf:scheme`: string>>"
_META = "array<struct<_name: string, _content: string>>"
_FIELDS = ", ".join(f"`{p}{n}`: {_ELEMENT}" for p in ("dc:", "") for n in (*_TEXTS, "identifier")) + f", `opf:meta`: {_META}, meta: {_META}"
SCHEMA = f"metadata struct<{_FIELDS}>, `opf:metadata` struct<{_FIELDS}>, __bad string"


def _renamed(xml: Column, space: str, to: str) -> Column:
    """The document with a namespace's prefix as it is called here."""
    prefix = F.regexp_extract(xml, rf"""xmlns:([\w.-]+)\s*=\s*["']{space.replace(".", "[.]")}["']""", 1)
    named = F.regexp_replace(xml, F.concat(F.lit(r"(</?|\s)\Q"), prefix, F.lit(r"\E:(?=[\w-])")), F.lit(f"$1{to}:"))
    return F.when((prefix != "") & (prefix != to), named).otherwise(xml)


def identity(xml: Column) -> Column:
    """struct(title, authors, roles, series, series_index, year, language, narrator, publisher, isbn_10, isbn_13, asin, description); null if broken or without a title.

    ``roles`` has each author's role, or null, in the same order.  Elements without a
    namespace stand in where those of Dublin Core are missing; of identifiers and pairs
    the last of a kind counts.
    """
    x = F.from_xml(_renamed(_renamed(xml, DC, "dc"), OPF, "opf"), SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    plain_names = ~F.coalesce(xml.rlike(rf"""xmlns\s*=\s*["']{OPF.replace(".", "[.]")}["']"""), F.lit(False))
    # Read once, and its elements told apart once.
    usable = let(x, lambda x: F.when(x["__bad"].isNull(), F.coalesce(x["opf:metadata"], x["metadata"])))
    return let(F.struct(usable.alias("m"), plain_names.alias("bare")), lambda r: F.when(r["m"].isNotNull(), _of_elements(r["m"], r["bare"])))


def _of_elements(m: Column, plain_names: Column) -> Column:
    """The identity of a metadata element; ``plain_names``: its elements without a prefix have no namespace."""
    elements = lambda n: F.coalesce(m[f"dc:{n}"], F.array().cast(_ELEMENT))
    bare = lambda n: F.coalesce(F.when(plain_names, m[n]), F.array().cast(_ELEMENT))
    full = lambda found: F.filter(found, lambda e: F.coalesce(e["_VALUE"] != "", F.lit(False)))
    # Of elements with one name only the first is asked for its text.
    first = lambda n: F.coalesce(*[F.nullif(F.try_element_at(found, F.lit(1))["_VALUE"], F.lit("")) for found in (elements(n), bare(n))])
    text = {n: strip(first(n)) for n in _TEXTS if n != "creator"}
    people = F.when(F.size(full(elements("creator"))) > 0, full(elements("creator"))).otherwise(full(bare("creator")))
    codes = F.transform(elements("identifier"), lambda e: F.struct(F.upper(F.coalesce(e["_opf:scheme"], F.lit(""))).alias("scheme"), strip(F.coalesce(e["_VALUE"], F.lit(""))).alias("code")))
    isbns = F.transform(F.filter(codes, lambda c: c["scheme"].isin(*ISBN_SCHEMES)), lambda c: F.regexp_replace(F.upper(c["code"]), "[^0-9X]", ""))
    isbn = lambda n: F.try_element_at(F.filter(isbns, lambda c: F.length(c) == n), F.lit(-1))
    pairs = F.concat(*[F.coalesce(p, F.array().cast(_META)) for p in (m["opf:meta"], m["meta"])])
    said = lambda n: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["_name"] == CALIBRE[n]), lambda p: F.coalesce(p["_content"], F.lit(""))), F.lit(-1))
    made = F.struct(
        text["title"].alias("title"), F.transform(people, lambda e: strip(e["_VALUE"])).alias("authors"), F.transform(people, lambda e: e["_opf:role"]).alias("roles"), said("series").alias("series"), said("series_index").alias("series_index"),
        F.regexp_extract(text["date"], YEAR, 1).try_cast("int").alias("year"), text["language"].alias("language"), said("narrator").alias("narrator"), text["publisher"].alias("publisher"), isbn(10).alias("isbn_10"), isbn(13).alias("isbn_13"),
        F.try_element_at(F.transform(F.filter(codes, lambda c: c["scheme"] == ASIN_SCHEME), lambda c: c["code"]), F.lit(-1)).alias("asin"), text["description"].alias("description"),
    )
    return F.when(F.coalesce(text["title"] != "", F.lit(False)), made)
