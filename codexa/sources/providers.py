"""Provider payloads in a JSON column, as one shape of identity.

Payloads are read as VARIANT, so a field may be missing, a scalar, a list or an
object without failing a row.  Every parser gives the columns of ``FIELDS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import YEAR, blank_to_null

FIELDS = ("title", "authors", "series", "volume", "year", "language", "narrator", "publisher", "isbn_10", "isbn_13", "asin", "runtime_minutes", "external_id", "cover_urls", "description")
# Keys of works, and where covers of a number lie, by size.
WORK_KEY = "/works/"
COVER_URL = "https://covers.openlibrary.org/b/id/{}-{}.jpg"
COVER_SIZES = ("L", "M", "S")
# The most hits that each source gives at once.
MOST_HITS = {"search": 100, "volumes": 40, "recordings": 50, "graph": 25}


def text(v: Column, *paths: str) -> Column:
    """The first path that holds text."""
    return F.coalesce(*[blank_to_null(F.try_variant_get(v, p, "string")) for p in paths])


def plain_text(v: Column, path: str) -> Column:
    """The text at a path, null if an object or list is there."""
    found = text(v, path)
    return F.when(~found.rlike(r"^[\[{]"), found)


def capped(hits: DataFrame, source: str, query: list[str], order: str, asked: int) -> DataFrame:
    """A query's first hits, no more than were asked for or its source gives at once."""
    most = F.create_map(*[F.lit(x) for kv in MOST_HITS.items() for x in kv])
    w = Window.partitionBy(source, *query).orderBy(order)
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.least(F.lit(asked), F.coalesce(F.try_element_at(most, F.col(source)), F.lit(asked))))


def texts(v: Column, path: str) -> Column:
    return F.coalesce(F.filter(F.try_variant_get(v, path, "array<string>"), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def names(v: Column, path: str, field: str) -> Column:
    """The field of each object of a list."""
    objects = F.try_variant_get(v, path, "array<variant>")
    found = F.transform(objects, lambda o: blank_to_null(F.try_variant_get(o, f"$.{field}", "string")))
    return F.coalesce(F.array_compact(found), F.array().cast("array<string>"))


def year(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, YEAR, 1).try_cast("int"), F.left(c, F.lit(4)).try_cast("int"))


def isbn(codes: Column, digits: int, last: bool = True) -> Column:
    """The last, or first, of the codes that has so many digits."""
    clean = F.filter(F.transform(codes, lambda c: F.regexp_replace(F.upper(c), "[^0-9X]", "")), lambda c: F.length(c) == digits)
    return F.try_element_at(clean, F.lit(-1 if last else 1))


def _shape(df: DataFrame, **fields: Column) -> DataFrame:
    kinds = {"authors": "array<string>", "year": "int", "runtime_minutes": "int", "cover_urls": "array<string>"}
    fields = {"cover_urls": F.array(), **fields}
    return df.select("*", *[fields.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in FIELDS])


def search_document(df: DataFrame, json: str) -> DataFrame:
    """A search hit: lists of authors, codes, publishers and languages; what has no key of a work, or no title, is left out."""
    v = F.try_parse_json(json)
    codes = texts(v, "$.isbn")
    key, cover = F.try_variant_get(v, "$.key", "string"), F.nullif(F.try_variant_get(v, "$.cover_i", "string"), F.lit("0"))
    covers = F.when(cover.isNotNull(), F.array(*[F.concat(F.lit(COVER_URL.split("{}")[0]), cover, F.lit(f"-{size}.jpg")) for size in COVER_SIZES])).otherwise(F.array().cast("array<string>"))
    df = df.filter(key.startswith(WORK_KEY) & text(v, "$.title").isNotNull())
    return _shape(
        df, external_id=key, cover_urls=covers, title=text(v, "$.title"), authors=texts(v, "$.author_name"), year=F.try_variant_get(v, "$.first_publish_year", "int"),
        language=text(v, "$.language[0]"), publisher=text(v, "$.publisher[0]"), isbn_10=isbn(codes, 10), isbn_13=isbn(codes, 13),
    )


def book_by_code(df: DataFrame, json: str) -> DataFrame:
    """A product record; its series may be an object or a list of them."""
    v = F.try_parse_json(json)
    return _shape(
        df, title=text(v, "$.title"), authors=names(v, "$.authors", "name"), narrator=F.try_element_at(names(v, "$.narrators", "name"), F.lit(1)),
        series=text(v, "$.seriesPrimary.name", "$.seriesPrimary[0].name"), volume=text(v, "$.seriesPrimary.position", "$.seriesPrimary[0].position"),
        year=year(text(v, "$.releaseDate")), language=text(v, "$.language"), publisher=text(v, "$.publisherName"), asin=text(v, "$.asin"),
        runtime_minutes=F.try_variant_get(v, "$.runtimeLengthMin", "int"), isbn_13=text(v, "$.isbn"),
        external_id=F.upper(text(v, "$.asin")), cover_urls=F.array_compact(F.array(text(v, "$.image"))), description=text(v, "$.summary", "$.description"),
    )


def volume(df: DataFrame, json: str) -> DataFrame:
    """A volume with typed identifiers; a category that says so names the series."""
    v = F.try_parse_json(json)
    codes = F.try_variant_get(v, "$.volumeInfo.industryIdentifiers", "array<variant>")
    code = lambda kind: F.try_element_at(F.transform(F.filter(codes, lambda o: F.try_variant_get(o, "$.type", "string") == kind), lambda o: F.try_variant_get(o, "$.identifier", "string")), F.lit(1))
    series = F.try_element_at(F.filter(texts(v, "$.volumeInfo.categories"), lambda c: F.lower(c).contains("series")), F.lit(1))
    return _shape(
        df, title=text(v, "$.volumeInfo.title"), authors=texts(v, "$.volumeInfo.authors"), series=series, year=year(F.split_part(text(v, "$.volumeInfo.publishedDate"), F.lit("-"), F.lit(1))),
        language=F.coalesce(text(v, "$.volumeInfo.language"), F.lit("en")), publisher=text(v, "$.volumeInfo.publisher"), isbn_10=code("ISBN_10"), isbn_13=code("ISBN_13"),
        external_id=text(v, "$.id"), description=text(v, "$.volumeInfo.description"),
        cover_urls=F.transform(F.map_values(F.try_variant_get(v, "$.volumeInfo.imageLinks", "map<string,string>")), lambda u: F.regexp_replace(u, "^http://", "https://")),
    )


def public_recording(df: DataFrame, json: str) -> DataFrame:
    """A volunteer recording: people by first and last name, distinct readers, seconds."""
    v = F.try_parse_json(json)
    people = F.transform(F.try_variant_get(v, "$.authors", "array<variant>"), lambda o: blank_to_null(F.concat_ws(" ", F.try_variant_get(o, "$.first_name", "string"), F.try_variant_get(o, "$.last_name", "string"))))
    readers = F.array_distinct(F.flatten(F.transform(F.try_variant_get(v, "$.sections", "array<variant>"), lambda s: names(s, "$.readers", "display_name"))))
    seconds = F.try_variant_get(v, "$.totaltimesecs", "int")
    return _shape(df, title=text(v, "$.title"), authors=F.array_compact(people), year=year(text(v, "$.copyright_year")), language=text(v, "$.language"), narrator=F.array_join(readers, ", "), runtime_minutes=F.floor(seconds / 60),
                  external_id=text(v, "$.id"), description=text(v, "$.description"), cover_urls=F.array_compact(F.array(F.concat(text(v, "$.url_project"), F.lit("/cover.jpg")))))


def overlay(best: Column, rest: Column) -> Column:
    """An edition's value over the work's."""
    return F.coalesce(best, rest)


def completeness(isbn_13: Column, date: Column, *others: Column) -> Column:
    """How much an edition tells: ten for a code, five for a date, one for each other field."""
    return F.when(isbn_13.isNotNull(), 10).otherwise(0) + F.when(date.isNotNull(), 5).otherwise(0) + sum((o.isNotNull().cast("int") for o in others), F.lit(0))


def product_page(df: DataFrame, json: str, asked: Column) -> DataFrame:
    """A record asked for by code: the code asked is the one it has; its covers from large to small, and its address."""
    v = F.try_parse_json(json)
    codes = F.array(asked)
    title = text(v, "$.title")
    return _shape(
        df, title=title, authors=names(v, "$.authors", "name"), year=F.regexp_extract(text(v, "$.publish_date"), YEAR, 1).try_cast("int"),
        external_id=text(v, "$.url"), cover_urls=F.array_compact(F.array(*[text(v, f"$.cover.{size}") for size in ("large", "medium", "small")])),
        publisher=F.try_element_at(names(v, "$.publishers", "name"), F.lit(1)), isbn_10=F.when(title.isNotNull(), isbn(codes, 10)), isbn_13=F.when(title.isNotNull(), isbn(codes, 13)),
    )


def search_row(df: DataFrame, json: str) -> DataFrame:
    """A search row: plain lists of names, series and codes; the last code of each length counts."""
    v = F.try_parse_json(json)
    codes = texts(v, "$.isbns")
    author = text(v, "$.author_names")
    authors = F.when(F.size(texts(v, "$.author_names")) > 0, texts(v, "$.author_names")).when(author.isNotNull() & ~author.startswith("["), F.array(author)).otherwise(F.array().cast("array<string>"))
    return _shape(df, title=text(v, "$.title"), authors=authors, series=F.try_element_at(texts(v, "$.series_names"), F.lit(1)), isbn_10=isbn(codes, 10), isbn_13=isbn(codes, 13))


def graph_book(df: DataFrame, json: str) -> DataFrame:
    """A book of a graph with its editions: the first codes, the last length in seconds."""
    v = F.try_parse_json(json)
    editions = F.try_variant_get(v, "$.editions", "array<variant>")
    field = lambda n, at: F.try_element_at(F.filter(F.transform(editions, lambda e: blank_to_null(F.try_variant_get(e, f"$.{n}", "string"))), lambda x: x.isNotNull()), F.lit(at))
    seconds = field("audio_seconds", -1).try_cast("int")
    people = F.transform(F.try_variant_get(v, "$.cached_contributors", "array<variant>"), lambda o: F.coalesce(blank_to_null(F.try_variant_get(o, "$.name", "string")), F.when(F.schema_of_variant(o) == "STRING", blank_to_null(F.try_variant_get(o, "$", "string")))))
    return _shape(
        df, title=text(v, "$.title"), authors=F.coalesce(F.array_compact(people), F.array().cast("array<string>")), series=text(v, "$.book_series[0].series.name"), volume=text(v, "$.book_series[0].position"),
        year=F.try_variant_get(v, "$.release_year", "int"), isbn_10=field("isbn_10", 1), isbn_13=field("isbn_13", 1), runtime_minutes=F.floor(seconds / 60),
        external_id=text(v, "$.id"), description=text(v, "$.description"), cover_urls=F.array_compact(F.array(F.coalesce(text(v, "$.cached_image.url"), plain_text(v, "$.cached_image")))),
    )


def library_item(json: Column) -> Column:
    """struct(id, title, author) of a server's item, wrapped or not."""
    v = F.try_parse_json(json)
    get = lambda *ps: F.coalesce(*[F.try_variant_get(v, p, "string") for p in ps])
    return F.struct(
        get("$.libraryItem.id", "$.id").alias("id"), get("$.libraryItem.media.metadata.title", "$.media.metadata.title", "$.libraryItem.title", "$.title").alias("title"),
        F.coalesce(get("$.libraryItem.media.metadata.authorName", "$.media.metadata.authorName"), F.lit("")).alias("author"),
    )


def probed_chapters(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, ord, title, start_ms, end_ms) of a prober's chapters; without a title they are numbered."""
    v = F.try_parse_json(json)
    rows = df.select(key, F.posexplode(F.try_variant_get(v, "$.chapters", "array<variant>")).alias("ord", "c"))
    at = lambda n: (F.try_variant_get("c", f"$.{n}", "string").try_cast("double") * 1000).cast("long")
    title = F.coalesce(blank_to_null(F.try_variant_get("c", "$.tags.title", "string")), F.concat(F.lit("Chapter "), (F.col("ord") + 1).cast("string")))
    return rows.select(key, "ord", title.alias("title"), at("start_time").alias("start_ms"), at("end_time").alias("end_ms"))
