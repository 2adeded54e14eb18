"""Queries on pages: the given ones, and product, search and account pages that are built from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import pages
from ..sources.shared import spread
from ..sources.tables import table
from .queries import query


def _cat(*parts):
    """Literals and columns as one text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(spark, d):
    """An order's lines as one row: what its page is built from, in order; the page itself is never shuffled."""
    one = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    li = table(spark, d, "lineitem").select("l_orderkey", *one).repartition("l_orderkey")
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*one))).alias("lines"))


def _page(lines, item, between):
    return F.array_join(F.transform(lines, item), between).alias("page")


@query("""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
a AS (SELECT *, regexp_extract(h, '<article>(.*?)</article>', 1, 's') AS article, regexp_extract(h, '<nav>(.*?)</nav>', 1, 's') AS nav FROM p)
SELECT page_id, trim(regexp_replace(regexp_replace(replace(regexp_extract(article, '<h1[^>]*>([^<]*)</h1>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(article, '<p>')) AS n_paragraphs,
  len(regexp_extract_all(nav, '<a ')) AS n_links, regexp_extract(nav, '<a href="([^"]*)"', 1) AS first_link, trim(regexp_replace(regexp_replace(replace(regexp_extract(h, '<div class="ad">([^<]*)</div>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS advert FROM a""")
def page_elements(spark, d):
    """P-H1: a page's parts by name, class and nesting; scripts and comments are no part of it."""
    tags = pages.tagged(table(spark, d, "pages"), "page_id", "html", "class", "href")
    named = lambda name: lambda t: t["name"] == name

    def parts(tags):
        return F.struct(
            *[pages.elements(tags, named(n)).alias(n) for n in ("article", "nav", "h1", "p")], pages.elements(tags, named("a"), href=lambda t: t["href"]).alias("a"),
            pages.elements(tags, lambda t: (t["name"] == "div") & pages.has_class(t["class"], "ad")).alias("ads"),
        )

    def read(tags, p):
        said = lambda e: F.coalesce(pages.cleaned(pages.told(tags, e)), F.lit(""))
        n_in = lambda inner, outer: F.aggregate(outer, F.lit(0).cast("long"), lambda n, o: n + F.size(pages.within(inner, o)))
        return F.struct(
            said(pages.head(pages.held(p["h1"], p["article"]))).alias("title"), n_in(p["p"], p["article"]).alias("n_paragraphs"), n_in(p["a"], p["nav"]).alias("n_links"),
            F.coalesce(pages.head(pages.held(p["a"], p["nav"]))["href"], F.lit("")).alias("first_link"), said(pages.head(p["ads"])).alias("advert"),
        )

    found = let(F.coalesce("tags", F.array()), lambda tags: let(parts(tags), lambda p: read(tags, p)))
    return tags.select("page_id", F.inline(F.array(found)))


@query("""
WITH p AS (SELECT *, p_partkey % 6 AS m FROM part)
SELECT p_partkey, CASE WHEN m = 4 THEN p_name || ' & "' || p_size || '"' ELSE p_name END AS title, CASE WHEN m = 5 THEN '' WHEN m IN (0, 2) THEN p_brand || '|Cy ' || p_type ELSE p_brand END AS authors,
  CASE m WHEN 5 THEN NULL WHEN 3 THEN 'Ann ' || p_type ELSE 'Bo ' || p_type END AS narrator, CASE m WHEN 5 THEN NULL WHEN 2 THEN p_type || ' Tales' ELSE p_type END AS series, CASE WHEN m NOT IN (2, 5) THEN CAST(p_size AS VARCHAR) END AS series_index,
  CASE WHEN m <> 5 THEN CAST(1970 + p_size AS INTEGER) END AS year, 'en' AS language, CASE m WHEN 5 THEN '' WHEN 3 THEN 'Short ' || p_name || '.' ELSE 'About ' || p_name || '. More.' END AS description,
  CASE WHEN m = 5 THEN '' WHEN m = 3 THEN 'https://m.audible.example/' || p_partkey || '.jpg' ELSE 'https://img.example/' || p_partkey || '.jpg' END AS covers, CASE m WHEN 5 THEN NULL WHEN 3 THEN p_size || ' mins' ELSE 'Length: ' || p_size || ' hrs and 7 mins' END AS runtime, CASE m WHEN 5 THEN NULL WHEN 3 THEN CAST(p_size AS INTEGER) ELSE CAST(p_size * 60 + 7 AS INTEGER) END AS runtime_minutes
FROM p WHERE m <> 1""")
def product_pages(spark, d):
    """S19, P8, P-S27: product pages by marks, else by labels; decoys in scripts and comments, elements that are never closed, attributes in other orders and quotes, references; without a title nothing."""
    # Pages are far larger than the columns that they are built from: these are spread and sorted first, by a number of parts that isn't lowered for their size.
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    p = p.repartition(spread(spark), "p_partkey").sortWithinPartitions("p_partkey")
    m, key, name, size, brand, kind = F.col("p_partkey") % 6, F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.col("p_brand"), F.col("p_type")
    decoy = "<script>var h = '<h1 class=\"bc-heading\">No</h1>';</script><!-- <li class=\"authorLabel\"><a>No</a></li> --><style>li a{}</style>"
    about = _cat("<div class='productPublisherSummary x bc-section'><p>About <b>", name, "</b>.</p>\n More.</div>")
    rest = _cat("<li class='runtimeLabel'><span>Length: ", size, " hrs and 7 mins</span></li></ul>", about, "<img alt=c class='bc-image-inset-border' src='//img.example/", key, ".jpg'/>")
    people = _cat("<ul><li class=\"bc-list-item authorLabel\"><span>By:</span><a href='/a'>", brand, "</a>, <a>", F.when(m == 4, " ").otherwise(_cat("Cy ", kind)), "</a></li><li class=narratorLabel>Read by <a>Bo\n", kind, "</a><a>Other</a></li>")
    series = _cat("<li class='seriesLabel'><a>", kind, F.when(m == 2, " Tales").otherwise(_cat(", Book ", size)), "</a></li><li class='releaseDateLabel'><span>Date</span><span data-qa=release-date>01-02-", 1970 + size, "</span></li>")
    marked = _cat("<html><head><title>x</title>", decoy, "</head><body><h1 class=\"bc-heading bc-size\">", name, F.when(m == 4, _cat(" &amp; &quot;", size, "&#34;")).otherwise(""), "</h1>", people, series, rest, "</body></html>")
    # Of elements that are never closed, the last of a list: it ends with the list.
    open_ended = F.replace(F.replace(marked, F.lit("</span></li></ul>"), F.lit("</span></ul>")), F.lit("</b>.</p>"), F.lit("</b>."))
    label = lambda said: f"<span class=\"bc-text x\">{said}</span>"
    labelled = _cat(
        "<h1 class=\"bc-heading\">", name, "</h1>", label(" By: "), "<a href=x>", brand, "</a>", label("Narrated by:"), " and <a>Ann ", kind, "</a>\n", label("Series:"), "<a>", kind, ", Book ", size, "</a>\n", label("Release date:"), " <span>June ", 1970 + size, "</span>\n",
        label("Publisher's Summary"), "\n<div><span>Short ", name, ".</span></div>\n", label("Length:"), "<span>", size, " mins</span><img src=\"//m.audible.example/", key, ".jpg\" class=\"bc-image-inset-border\">",
    )
    page = F.when(m == 1, F.replace(marked, F.lit("h1"), F.lit("h2"))).when(m == 3, labelled).when(m == 5, _cat("<h1 class='bc-heading'>", name)).when(m == 0, open_ended).otherwise(marked)
    page = F.when(m == 4, F.replace(page, F.lit(", <a> </a>"), F.lit(", <a> &nbsp;</a>"))).otherwise(page)
    found = pages.product(p.select("p_partkey", page.alias("page")), "p_partkey", "page")
    return found.withColumn("authors", F.array_join("authors", "|")).withColumn("covers", F.array_join("cover_urls", "|")).drop("cover_urls")


_LINE = "lpad(CAST(l_suppkey * 100 + l_linenumber AS VARCHAR), 10, '0')"


@query(f"""
WITH l AS (SELECT *, l_linenumber % 5 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) - 1 AS place, {_LINE} AS asin, 'Part ' || l_partkey AS title, CASE m WHEN 0 THEN 'A' || l_suppkey || '|' || l_returnflag WHEN 1 THEN 'By: ' || l_linestatus ELSE '' END AS authors,
  CASE m WHEN 0 THEN 'https://i.example/' || l_partkey || '.jpg' WHEN 1 THEN 'http://i.example/a.png' ELSE '' END AS covers,
  CASE m WHEN 0 THEN 'https://www.shop.example/pd/' || l_partkey || '?a=1&b=2' WHEN 4 THEN 'https://far.example/' || l_partkey ELSE 'https://www.shop.example/pd/' || {_LINE} END AS product_url FROM l WHERE m NOT IN (2, 3))
SELECT * FROM h""")
def search_pages(spark, d):
    """A page of hits for each order; a hit has a code and a heading, its link or its text as title."""
    head = lambda inner: _cat("<h3 class=\"bc-heading x\">", inner, "</h3>")

    def item(x):
        m, part = x["l_linenumber"] % 5, _cat("Part ", x["l_partkey"])
        code = F.lpad((x["l_suppkey"] * 100 + x["l_linenumber"]).cast("string"), 10, "0")
        one = _cat(head(_cat("<a href='/pd/", x["l_partkey"], "?a=1&amp;b=2'>", part, "</a>")), "<ul><li class='authorLabel'>By: <a>A", x["l_suppkey"], "</a><a>", x["l_returnflag"], "</a></li></ul><img src=\"//i.example/", x["l_partkey"], ".jpg\"><img src=x>")
        two = _cat(head(part), "<ul><li class=authorLabel>By: ", F.trim(x["l_linestatus"]), "</li></ul><img src='http://i.example/a.png'>")
        far = head(_cat("<a href=\"https://far.example/", x["l_partkey"], "\"> ", part, "</a>"))
        body = F.when(m == 0, one).when(m == 1, two).when(m == 2, _cat("<h3>", part, "</h3>")).when(m == 3, head("<a> </a>")).otherwise(far)
        return _cat("<div data-asin='", code, "'>", body, "</div>")

    page = _lines(spark, d).select("l_orderkey", _page("lines", item, "\n"))
    found = pages.search_hits(page, "l_orderkey", "page", "shop.example").withColumn("place", F.col("place").cast("long"))
    return found.withColumn("authors", F.array_join("authors", "|")).withColumn("covers", F.array_join("cover_urls", "|")).drop("cover_urls")


@query("""
WITH l AS (SELECT *, CASE WHEN l_quantity > 45 THEN '' ELSE lpad(CAST(CAST(l_quantity AS BIGINT) % 4 AS VARCHAR), 10, 'B') END AS asin, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
s AS (SELECT l_orderkey, asin, 'Part ' || l_partkey AS title, CASE WHEN l_linenumber % 3 = 0 THEN 'Unknown' ELSE l_linestatus END AS author, n FROM l WHERE asin <> '' QUALIFY row_number() OVER (PARTITION BY l_orderkey, asin ORDER BY n) = 1)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) - 1 AS place, asin, title, author FROM s""")
def account_pages(spark, d):
    """An account's titles with their codes, each where it is seen first; foreign links and codes of another length don't count."""
    def item(x):
        code = F.when(x["l_quantity"] > 45, "B00").otherwise(F.lpad((x["l_quantity"].cast("long") % 4).cast("string"), 10, "B"))
        author = F.when(x["l_linenumber"] % 3 == 0, "").otherwise(_cat("<a href='/author/x/1'> ", F.trim(x["l_linestatus"]), " </a>"))
        return _cat("<div><div class=row><a href='/other/B111111111'>f</a><span class='bc-text bc-size-headline3'> Part ", x["l_partkey"], "\n</span><a href='https://x.example/pd/Name-Audiobook/", code, "?ref=1'>go</a>", author, "</div></div>")

    page = _lines(spark, d).select("l_orderkey", _page("lines", item, ""))
    return pages.account_titles(page, "l_orderkey", "page").withColumn("place", F.col("place").cast("long"))
