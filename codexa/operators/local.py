"""Identities from what lies beside the files, and what is written from identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What lines of an information file may call each field.
SYNONYMS = {
    "title": "title", "book": "title", "name": "title", "author": "authors", "authors": "authors", "writer": "authors", "series": "series", "series name": "series",
    "series index": "series_index", "volume": "series_index", "narrator": "narrator", "reader": "narrator", "year": "year", "published": "year", "language": "language",
    "isbn": "isbn", "asin": "asin", "description": "description", "summary": "description",
}
FIELDS = ("title", "series", "series_index", "narrator", "year", "language", "isbn", "asin", "description")


def information(text: Column) -> Column:
    """struct(FIELDS..., authors) of ``key: value`` lines; the last of a field wins, authors add up."""
    keys = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.try_element_at(keys, F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    of = lambda n: F.filter(pairs, lambda p: p["k"] == n)
    last = {n: F.try_element_at(F.transform(of(n), lambda p: p["v"]), F.lit(-1)) for n in FIELDS}
    authors = F.flatten(F.transform(of("authors"), lambda p: X.author_list(p["v"])))
    return F.struct(*[c.alias(n) for n, c in last.items()], authors.alias("authors"))


def local_score(info: Column) -> Column:
    """How far a local file may be trusted: title and author together make .9 at least."""
    has = lambda n: F.coalesce(info[n] != "", F.lit(False))
    people = F.coalesce(F.size(info["authors"]) > 0, F.lit(False))
    points = lambda c, p: F.when(c, p).otherwise(0.0)
    score = 0.2 + points(has("title"), 0.3) + points(people, 0.3) + points(has("series"), 0.1) + points(has("year"), 0.05) + points(has("narrator"), 0.05)
    return F.when(has("title") & people, F.greatest(score, F.lit(0.9))).otherwise(score)


def output_name(title: Column, authors: Column, series: Column, volume: Column) -> Column:
    """The name of a converted file."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    t = F.when(~blank(series) & ~blank(volume), F.concat(series, F.lit(" "), volume, F.lit(" - "), title)).otherwise(title)
    first = F.try_element_at(authors, F.lit(1))
    named = F.when(first.isNotNull(), F.concat(first, F.lit(" - "), t)).otherwise(t)
    return F.concat(F.trim(F.left(F.regexp_replace(named, X.FORBIDDEN, "_"), F.lit(200))), F.lit(".m4b"))


def conversion_tags(title: Column, authors: Column, narrator: Column, year: Column, series: Column, volume: Column, isbn_13: Column, isbn_10: Column) -> Column:
    """A map of the tags to write; those without a value are left out."""
    first = F.try_element_at(authors, F.lit(1))
    isbn = F.coalesce(X.blank_to_null(isbn_13), X.blank_to_null(isbn_10))
    rows = {
        "title": title, "album": title, "artist": F.array_join(authors, ", "), "albumartist": first, "composer": narrator, "date": F.nullif(year, F.lit(0)).cast("string"), "series": series,
        "series_index": F.when(F.coalesce(series, F.lit("")) != "", volume), "isbn": isbn, "genre": F.lit("Audiobook"),
    }
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in rows.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(e["value"] != "", F.lit(False))))


def chapter_title(mode: str, tag: Column, index: Column, ordinal: Column) -> Column:
    """By tag, by track number, or either with a numbered chapter where the tag is missing."""
    tag = X.blank_to_null(tag)
    numbered = F.concat(F.lit("Chapter "), ordinal.cast("string"))
    return F.concat(F.lit("Track "), index.cast("string")) if mode == "track_number" else F.coalesce(tag, numbered)


def alias_classes(aliases: DataFrame) -> DataFrame:
    """(name, class) rows of (canonical, alias) ones; entries of one canonical name add up."""
    a = aliases.select(F.lower(F.trim("canonical")).alias("class"), F.lower(F.trim("alias")).alias("name"))
    return a.unionByName(a.select("class", F.col("class").alias("name"))).distinct()


def same_person(pairs: DataFrame, a: str, b: str, classes: DataFrame) -> DataFrame:
    """Adds ``alias``: both names are in one class; classes don't chain."""
    grouped = classes.groupBy("name").agg(F.collect_set("class").alias("classes"))
    left, right = (grouped.select(F.col("name").alias(c), F.col("classes").alias(f"{c}_classes")) for c in (a, b))
    both = pairs.join(left, a, "left").join(right, b, "left")
    return both.withColumn("alias", F.coalesce(F.arrays_overlap(f"{a}_classes", f"{b}_classes"), F.lit(False))).drop(f"{a}_classes", f"{b}_classes")


def cached(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests with their cached response; expired ones answer nothing, those without expiry always."""
    live = cache.filter(F.col("expires_at").isNull() | ~(now > F.col("expires_at"))).select("provider", "query_hash", "response")
    return requests.join(live, ["provider", "query_hash"], "left")


def without_expired(cache: DataFrame, now: Column) -> DataFrame:
    """The entries that haven't expired; those without expiry never do."""
    return cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def without_provider(cache: DataFrame, provider: Column) -> DataFrame:
    return cache.filter(~F.col("provider").eqNullSafe(provider))
