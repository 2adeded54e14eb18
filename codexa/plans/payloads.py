"""Queries on documents and payloads, which are built from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import local
from ..sources import documents, providers, sidecars
from ..sources.tables import table
from .queries import query


def _part(spark, d):
    return table(spark, d, "part")


def _json(**fields):
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _code(n, width):
    return F.lpad(n.cast("string"), width, "0")


@query("""
WITH p AS (SELECT *, p_partkey % 9 AS m FROM part)
SELECT p_partkey, p_name AS title, CASE WHEN m = 1 THEN NULL ELSE p_brand END AS author, CASE WHEN m <> 2 THEN '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS isbn_13, CASE WHEN m <> 2 THEN lpad(CAST(p_size AS VARCHAR), 10, '0') END AS isbn_10,
  CASE WHEN m <> 3 THEN CAST(1990 + p_size AS INTEGER) END AS year, CASE WHEN m <> 4 THEN 'eng' END AS language, CASE WHEN m = 1 THEN 0 ELSE 1 END AS n_authors, '/works/OL' || p_partkey || 'W' AS external_id,
  CASE WHEN m = 5 THEN '' ELSE 'https://covers.openlibrary.org/b/id/' || (p_size + 7) || '-L.jpg|https://covers.openlibrary.org/b/id/' || (p_size + 7) || '-M.jpg|https://covers.openlibrary.org/b/id/' || (p_size + 7) || '-S.jpg' END AS covers
FROM p WHERE m < 6""")
def search_documents(spark, d):
    """S15, P1, P-A1, P-S28: search hits as identities; broken ones, other keys and blank titles are left out; of codes the last of each length."""
    p = _part(spark, d)
    m = F.col("p_partkey") % 9
    some = lambda n, c: F.when(m != n, c)
    codes = F.array(F.lit("0000000001"), F.concat(F.lit("978-"), _code(F.col("p_partkey"), 10)), _code(F.col("p_size"), 10), F.lit("12"))
    key = F.concat(F.when(m == 6, "/books/OL").otherwise("/works/OL"), F.col("p_partkey").cast("string"), F.lit("W"))
    j = _json(key=key, title=F.when(m == 7, " ").otherwise(F.col("p_name")), author_name=some(1, F.array("p_brand")), isbn=some(2, codes), first_publish_year=some(3, F.col("p_size") + 1990),
              language=some(4, F.array(F.lit("eng"), F.lit("ger"))), cover_i=F.when(m == 5, 0).otherwise(F.col("p_size") + 7))
    j = F.when(m == 8, F.left(j, F.length(j) - 3)).otherwise(j)
    f = providers.search_document(p.select("p_partkey", j.alias("j")), "j")
    return f.select("p_partkey", "title", F.try_element_at("authors", F.lit(1)).alias("author"), "isbn_13", "isbn_10", "year", "language", F.size("authors").alias("n_authors"), "external_id", F.array_join("cover_urls", "|").alias("covers"))


@query("""
WITH p AS (SELECT *, p_partkey % 6 AS m, CAST(p_partkey AS VARCHAR) AS k FROM part)
SELECT p_partkey, CASE WHEN m <> 5 THEN 'v' || k END AS volume_id, CASE WHEN m IN (0, 1) THEN 'https://i/' || k || CASE WHEN m = 1 THEN '|https://j/' || k ELSE '' END ELSE '' END AS volume_covers, CASE WHEN m = 2 THEN p_type WHEN m = 5 THEN NULL ELSE NULL END AS volume_about, CASE WHEN m = 3 THEN 'de' ELSE 'en' END AS volume_lang,
  'B' || k AS book_id, CASE WHEN m = 0 THEN 'u' || k ELSE '' END AS book_covers, CASE WHEN m = 1 THEN p_brand WHEN m = 2 THEN p_type END AS book_about,
  CASE WHEN m = 4 THEN 'https://p/' || k || '/cover.jpg' ELSE '' END AS recording_covers, k AS graph_id, CASE WHEN m < 2 THEN 'c' || k ELSE '' END AS graph_covers FROM p""")
def provider_extras(spark, d):
    """S16 to S20, P4 to P7, P-J1: identifiers, covers and descriptions of every source; plain links become secure ones, broken payloads give nothing."""
    p = _part(spark, d)
    m, k = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    at = lambda *ns: m.isin(*ns)
    links = F.when(m == 0, F.create_map(F.lit("small"), F.concat(F.lit("http://i/"), k))).when(m == 1, F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.concat(F.lit("https://i/"), k), F.concat(F.lit("http://j/"), k))))
    volume = _json(id=F.concat(F.lit("v"), k), volumeInfo=F.struct(F.col("p_name").alias("title"), links.alias("imageLinks"), F.when(m == 2, F.col("p_type")).alias("description"), F.when(m == 3, "de").alias("language")))
    volume = F.when(m == 5, F.lit("{broken")).otherwise(volume)
    book = _json(asin=F.concat(F.lit("b"), k), image=F.when(m == 0, F.concat(F.lit("u"), k)).when(m == 3, ""), summary=F.when(m == 1, F.col("p_brand")).when(m == 2, ""), description=F.when(at(1, 2), F.col("p_type")))
    recording = _json(id=k, url_project=F.when(m == 4, F.concat(F.lit("https://p/"), k)))
    graph = F.when(m == 0, _json(id=k, cached_image=F.concat(F.lit("c"), k))).when(m == 1, _json(id=k, cached_image=F.struct(F.concat(F.lit("c"), k).alias("url")))).otherwise(_json(id=k, cached_image=F.struct(F.lit(1).alias("w"))))
    out = p.select("p_partkey")
    for name, parse, json, kept in (
        ("volume", providers.volume, volume, ("id", "covers", "about", "lang")), ("book", providers.book_by_code, book, ("id", "covers", "about")), ("recording", providers.public_recording, recording, ("covers",)), ("graph", providers.graph_book, graph, ("id", "covers")),
    ):
        fields = {"id": F.col("external_id"), "covers": F.coalesce(F.array_join("cover_urls", "|"), F.lit("")), "about": F.col("description"), "lang": F.col("language")}
        out = out.join(parse(p.select("p_partkey", json.alias("j")), "j").select("p_partkey", *[fields[f].alias(f"{name}_{f}") for f in kept]), "p_partkey")
    return out


@query("""
SELECT p_partkey, p_name AS title, p_type AS publisher, CAST(1990 + p_size % 30 AS INTEGER) AS year, '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn_13, CASE WHEN p_size > 25 THEN p_brand ELSE 'work' END AS author FROM part""")
def records_by_isbn(spark, d):
    """A record by code, its edition's fields over its work's."""
    p = _part(spark, d)
    j = _json(title=F.col("p_name"), publish_date=F.concat(F.lit("May "), (F.col("p_size") % 30 + 1990).cast("string")), publishers=F.array(F.struct(F.col("p_type").alias("name"))), authors=F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_brand").alias("name")))))
    f = providers.product_page(p.select("p_partkey", j.alias("j"), F.concat(F.lit("978-"), _code(F.col("p_partkey"), 10)).alias("c")), "j", F.col("c"))
    return f.select("p_partkey", "title", "publisher", "year", "isbn_13", providers.overlay(F.try_element_at("authors", F.lit(1)), F.lit("work")).alias("author"))


@query("""
SELECT p_partkey, p_name AS title, p_brand AS series, CAST(p_size AS VARCHAR) AS volume, CAST(2000 + p_size % 20 AS INTEGER) AS year, CAST(p_size * 10 AS INTEGER) AS runtime_minutes, p_type AS narrator FROM part""")
def books_by_code(spark, d):
    """S16, P4, P-J1: a record whose series is an object or a list."""
    p = _part(spark, d)
    one = F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("position"))
    common = {"title": F.col("p_name"), "releaseDate": F.concat((F.col("p_size") % 20 + 2000).cast("string"), F.lit("-05-01")), "runtimeLengthMin": F.col("p_size") * 10, "narrators": F.array(F.struct(F.col("p_type").alias("name")))}
    j = F.when(F.col("p_partkey") % 2 == 0, _json(seriesPrimary=one, **common)).otherwise(_json(seriesPrimary=F.array(one), **common))
    return providers.book_by_code(p.select("p_partkey", j.alias("j")), "j").select("p_partkey", "title", "series", "volume", "year", "runtime_minutes", "narrator")


@query("""
SELECT p_partkey, p_name AS title, CASE WHEN p_size > 25 THEN p_brand || ' Series' END AS series, CAST(1990 + p_size % 30 AS INTEGER) AS year, lpad(CAST(p_partkey AS VARCHAR), 13, '9') AS isbn_13, CAST(NULL AS VARCHAR) AS isbn_10 FROM part""")
def catalogue_volumes(spark, d):
    """S17, P5, P-A2: typed identifiers, a series among the categories."""
    p = _part(spark, d)
    ids = F.array(F.struct(F.lit("OTHER").alias("type"), F.lit("x").alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"), F.lpad(F.col("p_partkey").cast("string"), 13, "9").alias("identifier")))
    kinds = F.when(F.col("p_size") > 25, F.array(F.lit("Fiction"), F.concat("p_brand", F.lit(" Series")))).otherwise(F.array(F.lit("Fiction")))
    info = F.struct(F.col("p_name").alias("title"), F.concat((F.col("p_size") % 30 + 1990).cast("string"), F.lit("-09")).alias("publishedDate"), ids.alias("industryIdentifiers"), kinds.alias("categories"))
    return providers.volume(p.select("p_partkey", _json(volumeInfo=info).alias("j")), "j").select("p_partkey", "title", "series", "year", "isbn_13", "isbn_10")


@query("""
SELECT p_partkey, p_name AS title, 'Ann ' || p_type AS author, CASE WHEN p_brand = 'x' THEN 'x' ELSE p_brand || ', Second' END AS narrator, CAST(p_size AS INTEGER) AS runtime_minutes, 2 AS n_readers FROM part""")
def public_recordings(spark, d):
    """People by two names, distinct readers of sections, seconds."""
    p = _part(spark, d)
    reader = lambda c: F.struct(F.array(F.struct(c.alias("display_name"))).alias("readers"))
    j = _json(title=F.col("p_name"), authors=F.array(F.struct(F.lit("Ann").alias("first_name"), F.col("p_type").alias("last_name"))), sections=F.array(reader(F.col("p_brand")), reader(F.lit("Second")), reader(F.col("p_brand"))), totaltimesecs=F.col("p_size") * 60 + 59)
    f = providers.public_recording(p.select("p_partkey", j.alias("j")), "j")
    return f.select("p_partkey", "title", F.try_element_at("authors", F.lit(1)).alias("author"), "narrator", "runtime_minutes", F.size(F.split("narrator", ", ")).alias("n_readers"))


@query("""
SELECT p_partkey, p_name AS title, p_brand AS author, p_type AS series, CAST(p_size AS VARCHAR) AS volume, '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn_13, CAST(p_size AS INTEGER) AS runtime_minutes, '978' || lpad(CAST(p_size AS VARCHAR), 10, '0') AS searched FROM part""")
def graph_books(spark, d):
    """S20, P7, P-J1: of editions the first code and the last length; of a search row the last code."""
    p = _part(spark, d)
    edition = lambda code, s: F.struct(code.alias("isbn_13"), s.alias("audio_seconds"))
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("int")
    editions = F.array(edition(none, F.lit(7)), edition(F.concat(F.lit("978"), _code(F.col("p_partkey"), 10)), F.col("p_size") * 60), edition(F.lit("9780000000000"), zero))
    series = F.array(F.struct(F.struct(F.col("p_type").alias("name")).alias("series"), F.col("p_size").alias("position")))
    j = _json(id=F.col("p_partkey"), title=F.col("p_name"), cached_contributors=F.array(F.struct(F.col("p_brand").alias("name"))), book_series=series, editions=editions)
    row = _json(title=F.col("p_name"), isbns=F.array(F.lit("9781111111111"), F.concat(F.lit("978-"), _code(F.col("p_size"), 10))))
    f = providers.graph_book(p.select("p_partkey", j.alias("j"), row.alias("r")), "j").withColumnRenamed("isbn_13", "code").withColumnRenamed("title", "t")
    keep = f.select("p_partkey", "r", F.col("t").alias("book_title"), F.try_element_at("authors", F.lit(1)).alias("author"), F.col("series").alias("book_series"), F.col("volume").alias("book_volume"), "code", F.col("runtime_minutes").alias("minutes"))
    s = providers.search_row(keep, "r")
    return s.select("p_partkey", F.col("book_title").alias("title"), "author", F.col("book_series").alias("series"), F.col("book_volume").alias("volume"), F.col("code").alias("isbn_13"), F.col("minutes").alias("runtime_minutes"), F.col("isbn_13").alias("searched"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'i' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id, CASE c_custkey % 3 WHEN 1 THEN c_mktsegment ELSE c_name END AS title, CASE c_custkey % 3 WHEN 1 THEN '' ELSE c_mktsegment END AS author FROM customer""")
def server_items(spark, d):
    """P20, P-J2, S22: items of a server's listing, wrapped or not."""
    c = table(spark, d, "customer")
    media = F.struct(F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("authorName")).alias("metadata"))
    k = F.col("c_custkey")
    j = F.when(k % 3 == 0, _json(id=k, media=media)).when(k % 3 == 1, _json(id=k, title=F.col("c_mktsegment"))).otherwise(_json(libraryItem=F.struct(F.concat(F.lit("i"), k.cast("string")).alias("id"), media.alias("media"))))
    i = providers.library_item(j)
    return c.select("c_custkey", i["id"].alias("id"), i["title"].alias("title"), i["author"].alias("author"))


@query("""
WITH c AS (SELECT conv_id, turn, any_value(role) AS role FROM conversations GROUP BY ALL),
n AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, turn, role FROM c)
SELECT conv_id, ord, CASE WHEN turn % 2 = 0 THEN role ELSE 'Chapter ' || (ord + 1) END AS title, turn * 1500 AS start_ms, turn * 1500 + 1500 AS end_ms FROM n""")
def probed_chapters(spark, d):
    """Chapters as a prober tells them."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    one = F.struct("turn", (F.col("turn") * 1.5).cast("string").alias("start_time"), (F.col("turn") * 1.5 + 1.5).cast("string").alias("end_time"), F.when(F.col("turn") % 2 == 0, F.struct(F.col("role").alias("title"))).alias("tags"))
    j = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("chapters"))).alias("j"))
    return providers.probed_chapters(j, "conv_id", "j")


@query("""
SELECT p_partkey, p_name AS title, CASE WHEN p_size > 25 THEN p_brand END AS creator, 'en' AS language, CASE WHEN p_size > 25 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '9') END AS identifier FROM part""")
def opf_round_trip(spark, d):
    """S9, K4, P-X1: package documents written, and read back."""
    p = _part(spark, d)
    some = lambda c: F.when(F.col("p_size") > 25, c)
    x = documents.opf(F.col("p_name"), some(F.col("p_brand")), F.lit("en"), some(F.lpad(F.col("p_partkey").cast("string"), 13, "9")))
    f = sidecars.opf_fields(F.col("x"))
    return p.select("p_partkey", x.alias("x")).select("p_partkey", *[f[n].alias(n) for n in ("title", "creator", "language", "identifier")])


@query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, role AS title, turn * 8000 AS start_ms, lead(turn * 8000) OVER (PARTITION BY conv_id ORDER BY turn) AS end_ms FROM (SELECT conv_id, turn, any_value(role) AS role FROM conversations GROUP BY ALL)""")
def cue_round_trip(spark, d):
    """S14, K7, W2, UD8, P-M6: cue sheets written and read back, each track until the next."""
    from ..operators import tracks

    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).withColumn("ms", (F.col("turn") * 8000).cast("long"))
    sheet = documents.cue_sheets(c, "conv_id", "role", "ms", F.lit("book.m4b"))
    return tracks.chapter_ends(sidecars.cue_tracks(sheet, "conv_id", "text"), "conv_id", "start_ms", "ord").select("conv_id", "ord", "title", "start_ms", "end_ms")


@query("""
SELECT p_partkey, p_name AS title, CASE WHEN p_size > 25 THEN 'Ann;Bo' ELSE '' END AS authors, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS series, round(CASE WHEN p_size > 25 THEN greatest(0.9, 0.85 + CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0 END) ELSE 0.55 + CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0 END END, 6) AS score FROM part""")
def local_identity(spark, d):
    """P9, S12, P-S26, P-A4: fields by synonym, authors that add up, and what they are worth."""
    p = _part(spark, d)
    people = F.when(F.col("p_size") > 25, "Writer: Ann\nauthors: Bo\n").otherwise("")
    series = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Series Name : "), "p_brand", F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("Title: draft\nno pair\nunknown: x\n"), people, series, F.lit("Published: 1999\r\nBook: "), "p_name")
    i = local.information(F.col("t"))
    return p.select("p_partkey", text.alias("t")).select("p_partkey", i.alias("i")).select("p_partkey", "i.title", F.array_join("i.authors", ";").alias("authors"), "i.series", F.round(local.local_score(F.col("i")), 6).alias("score"))


@query("""
SELECT p_partkey, 'Ann_Bo - ' || CASE WHEN p_size > 25 THEN p_brand || ' ' || p_size || ' - ' ELSE '' END || p_name || '.m4b' AS name,
  '{"title":"' || p_name || '","album":"' || p_name || '","artist":"Ann/Bo, Cy","albumartist":"Ann/Bo","date":"' || (1990 + p_size) || '"' || CASE WHEN p_size > 25 THEN ',"series":"' || p_brand || '","series_index":"' || p_size || '"' ELSE '' END || ',"isbn":"10x","genre":"Audiobook"}' AS tags,
  CASE WHEN p_size > 25 THEN p_name ELSE 'Chapter ' || p_size END AS auto_title, 'Track ' || p_size AS numbered_title FROM part""")
def conversion_outputs(spark, d):
    """Names, tags and chapter titles of converted files."""
    p = _part(spark, d)
    some = lambda c: F.when(F.col("p_size") > 25, c)
    authors, volume = F.array(F.lit("Ann/Bo"), F.lit("Cy")), F.col("p_size").cast("string")
    tags = local.conversion_tags(F.col("p_name"), authors, F.lit(""), F.col("p_size") + 1990, some(F.col("p_brand")), volume, F.lit(" "), F.lit("10x"))
    return p.select("p_partkey", local.output_name(F.col("p_name"), authors, some(F.col("p_brand")), volume).alias("name"), F.to_json(tags).alias("tags"),
                    local.chapter_title("auto", some(F.col("p_name")), F.col("p_size"), F.col("p_size")).alias("auto_title"), local.chapter_title("track_number", F.col("p_name"), F.col("p_size"), F.col("p_size")).alias("numbered_title"))


@query("""
WITH a AS (SELECT DISTINCT lower(p_type) AS class, lower(p_brand) AS name FROM part WHERE p_size < 5), c AS (SELECT * FROM a UNION SELECT DISTINCT class, class FROM a),
n AS (SELECT DISTINCT lower(p_brand) AS x FROM part), t AS (SELECT DISTINCT lower(p_type) AS y FROM part)
SELECT x, y, EXISTS (SELECT 1 FROM c c1 JOIN c c2 ON c1.class = c2.class WHERE c1.name = x AND c2.name = y) AS alias FROM (SELECT DISTINCT lower(p_brand) AS x, lower(p_type) AS y FROM part)""")
def author_aliases(spark, d):
    """S27, J4, U7, T14, P-A3: names of one class, classes that add up but don't chain."""
    p = _part(spark, d)
    classes = local.alias_classes(p.filter("p_size < 5").select(F.col("p_type").alias("canonical"), F.col("p_brand").alias("alias")))
    pairs = p.select(F.lower("p_brand").alias("x"), F.lower("p_type").alias("y")).distinct()
    return local.same_person(pairs, "x", "y", classes).select("x", "y", "alias")


@query("""
WITH c AS (SELECT user_id AS query_hash, event_type AS provider, arg_max(value, (ts, event_id)) AS response, max(ts) AS stamp FROM events GROUP BY ALL),
r AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS query_hash, CASE WHEN c_custkey % 2 = 0 THEN 'view' ELSE 'purchase' END AS provider FROM customer)
SELECT r.provider, r.query_hash, c.response FROM r LEFT JOIN c ON c.provider = r.provider AND c.query_hash = r.query_hash AND (c.provider = 'view' OR NOT (TIMESTAMP '2024-01-25' > c.stamp + INTERVAL 10 DAY))""")
def cache_lookup(spark, d):
    """The newest entry of each key, unless it has expired; some never do."""
    e = table(spark, d, "events")
    rows = e.select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("provider"), F.col("user_id").alias("query_hash"), F.struct("ts", "event_id").alias("stamp"), F.col("value").alias("response"))
    newest = documents.upsert(rows.filter("false"), rows, "key", "stamp")
    entries = newest.withColumn("expires_at", F.when(F.col("provider") != "view", F.col("stamp.ts") + F.expr("INTERVAL 10 DAYS")))
    asked = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("query_hash"), F.when(F.col("c_custkey") % 2 == 0, "view").otherwise("purchase").alias("provider")).distinct()
    return local.cached(asked, entries, F.lit("2024-01-25 00:00:00").cast("timestamp")).select("provider", "query_hash", "response")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS DOUBLE) + 0.5 WHEN 1 THEN CAST(epoch_us(date_trunc('second', ts)) AS DOUBLE) / 1000000.0 ELSE 0.0 END AS seconds, round(length(props) / 1048576.0, 2) AS mb, CAST(trunc(value) AS BIGINT) AS whole FROM events""")
def stamp_values(spark, d):
    """P-D3, P-D4, P-M3, P-M7, T10: stamps as number or text, sizes and whole numbers."""
    k = F.col("event_id") % 3
    stamp = F.when(k == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, d, "events").select("event_id", X.epoch_seconds(stamp).alias("seconds"), F.round(F.length("props") / 1048576.0, 2).alias("mb"), F.col("value").cast("long").alias("whole"))
