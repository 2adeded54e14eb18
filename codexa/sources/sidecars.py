"""Sidecar documents in a column: NFO, cue sheets, loose JSON, OPF and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, squeeze


def key_values(text: Column) -> Column:
    """A map of ``key: value`` and ``key=value`` lines; the last of a key wins."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z][\w ]*\s*[:=]"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^\s*([^:=]+)[:=]", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:=]+[:=](.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def cue_tracks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, title, start_ms) of each INDEX 01 of a cue sheet."""
    tracks = F.split(F.col(text), r"(?m)^\s*TRACK\s+")
    parts = df.select(key, F.posexplode(F.filter(tracks, lambda _, i: i > 0)).alias("ord", "body"))
    at = r"INDEX\s+01\s+(\d+):(\d+):(\d+)"
    n = [F.regexp_extract("body", at, i).try_cast("long") for i in (1, 2, 3)]
    start = n[0] * 60000 + n[1] * 1000 + F.floor(n[2] * 1000 / 75)
    return parts.filter(F.col("body").rlike(at)).select(key, "ord", blank_to_null(F.regexp_extract("body", r'TITLE\s+"([^"]*)"', 1)).alias("title"), start.alias("start_ms"))


def loose_text(json: Column, path: str) -> Column:
    """A string however it is given: text, number, first of a list, or ``name`` of an object."""
    v = F.try_parse_json(json)
    ways = [path, f"{path}[0]", f"{path}.name", f"{path}[0].name"]
    return F.coalesce(*[F.when(~F.coalesce(F.try_variant_get(v, w, "string"), F.lit("")).rlike(r"^[\[{]"), blank_to_null(F.try_variant_get(v, w, "string"))) for w in ways])


def opf_fields(xml: Column) -> dict[str, Column]:
    """Dublin Core elements, with or without a prefix."""
    get = lambda n: blank_to_null(F.xpath_string(xml, F.lit(f"//*[local-name()='{n}']")))
    return {n: get(n) for n in ("title", "creator", "language", "publisher", "date", "identifier")}


def html_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"&[A-Za-z]+;|&#\d+;", " "))


NFO = "title string, author string, artist string, year string, narrator string, publisher string, description string, plot string, __bad string"


def nfo_identity(text: Column) -> Column:
    """struct(title, authors, year, narrator, publisher, description) of an NFO: as XML if it is, else of its lines; null without a title."""
    x = F.from_xml(F.when(text.rlike(r"^\s*<"), text), NFO, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    lines = key_values(text)
    line = lambda *ns: F.coalesce(*[F.try_element_at(lines, F.lit(n)) for n in ns])
    people = lambda c: F.coalesce(F.transform(F.split(F.nullif(c, F.lit("")), ","), lambda x: F.trim(x)), F.array().cast("array<string>"))
    year = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("int"))
    made = lambda t, a, y, n, p, about: F.struct(t.alias("title"), people(a).alias("authors"), year(y).alias("year"), n.alias("narrator"), p.alias("publisher"), about.alias("description"))
    of_xml = made(blank_to_null(x["title"]), F.coalesce(blank_to_null(x["author"]), blank_to_null(x["artist"])), x["year"], blank_to_null(x["narrator"]), blank_to_null(x["publisher"]), F.coalesce(blank_to_null(x["description"]), blank_to_null(x["plot"])))
    of_lines = made(F.nullif(line("title"), F.lit("")), line("author", "artist"), line("year"), line("narrator"), line("publisher"), line("description", "plot"))
    return F.when(x["__bad"].isNull() & of_xml["title"].isNotNull(), of_xml).when(of_lines["title"].isNotNull(), of_lines)


# Sidecars by which a folder is known, first ones first; then any NFO by name.
DETECTED = ("metadata.opf", "content.opf", ".metadata.json", "metadata.json")


def detected(files: DataFrame, folder: str, name: str, body: str) -> DataFrame:
    """(folder, name, title): each folder's first sidecar with a title, package documents before JSON before NFO."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in DETECTED]), F.col(name)), F.lit(0)), F.when(F.col(name).endswith(".nfo"), 100))
    x = F.from_xml(F.when(F.col(name).endswith(".opf"), F.col(body)), "metadata struct<title: string, `dc:title`: string>, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    title = F.when(F.col(name).endswith(".opf"), F.coalesce(blank_to_null(x["metadata"]["dc:title"]), blank_to_null(x["metadata"]["title"])))
    title = title.when(F.col(name).endswith(".json"), loose_text(F.col(body), "$.title")).otherwise(nfo_identity(F.col(body))["title"])
    usable = files.withColumn("rank", rank).withColumn("found", title).filter("rank IS NOT NULL AND found IS NOT NULL")
    best = usable.groupBy(folder).agg(F.min(F.struct("rank", name, "found")).alias("s"))
    return best.select(folder, F.col(f"s.{name}").alias(name), F.col("s.found").alias("title"))
