"""Queries on sidecars in all the shapes that they come in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import loose, packages
from ..sources.tables import table
from .pages import _cat
from .queries import query

#: A value's shapes; {b} is a name and {n} a number.
SHAPES = ('"{b}"', '"  {b} "', "{n}", "[]", '{{"name":"{b}"}}', '[{{"other":1,"title":"{b}"}},"x"]', "null", "true", '[null,"",{{"value":["{b}"]}}]', '{{"x":1}}', "{n}.5", '"no. {n}, 2nd"')


def _sql_value(name: str, shift: int) -> str:
    shapes = [f"WHEN {i} THEN '" + s.replace("{b}", "' || p_name || '").replace("{n}", "' || p_size || '").replace("{{", "{").replace("}}", "}") + "'" for i, s in enumerate(SHAPES)]
    return f"""'"{name}":' || CASE (p_partkey + {shift}) % {len(SHAPES)} {' '.join(shapes)} END"""


def _sql_scalar(x: str, depth: int) -> str:
    """The first text or number in a JSON value, so many levels deep."""
    plain = f"CASE WHEN json_type({x}) = 'VARCHAR' THEN nullif(trim({x} ->> '$'), '') WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN {x} ->> '$'"
    if not depth:
        return plain + " END"
    keys = ", ".join(_sql_scalar(f"json_extract({x}, '$.{k}')", depth - 1) for k in loose.NAMING)
    v = f"v{depth}"
    return f"{plain} WHEN json_type({x}) = 'OBJECT' THEN coalesce({keys}) WHEN json_type({x}) = 'ARRAY' THEN list_filter(list_transform(CAST({x} AS JSON[]), lambda {v}: {_sql_scalar(v, depth - 1)}), lambda z: z IS NOT NULL)[1] END"


_DOC = "'{' || " + " || ',' || ".join(_sql_value(n, i) for i, n in enumerate(("title", "series", "year", "narrator", "authors"))) + " || '}'"


@query(f"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN left({_DOC}, 30) ELSE {_DOC} END AS t FROM part), j AS (SELECT p_partkey, CAST(t AS JSON) AS j FROM t WHERE json_valid(t)),
f AS (SELECT p_partkey, j -> '$.title' AS a, j -> '$.series' AS b, j -> '$.year' AS c, j -> '$.narrator' AS d, j -> '$.authors' AS e FROM j),
g AS (SELECT p_partkey, {_sql_scalar("a", 3)} AS title, {_sql_scalar("b", 3)} AS series, CAST(nullif(regexp_extract({_sql_scalar("c", 3)}, '-?\\d+'), '') AS BIGINT) AS year, {_sql_scalar("d", 3)} AS narrator,
  list_filter(CASE WHEN json_type(e) = 'ARRAY' THEN list_transform(CAST(e AS JSON[]), lambda y: {_sql_scalar("y", 2)}) ELSE [{_sql_scalar("e", 3)}] END, lambda z: z IS NOT NULL) AS authors FROM f)
SELECT p_partkey, title, series, year, narrator, array_to_string(authors, '|') AS authors FROM g WHERE title IS NOT NULL""")
def loose_sidecars(spark, d):
    """S10, P-S31, P-J1, P-J2, K5: each field as text, number, list, object, list of objects, nothing or broken; a value is what it holds first."""
    p = table(spark, d, "part")

    def value(name, shift):
        k, found = (F.col("p_partkey") + shift) % len(SHAPES), None
        for i, s in enumerate(SHAPES):
            parts = [x for x in s.replace("{{", "\x01").replace("}}", "\x02").replace("{b}", "\x03b\x03").replace("{n}", "\x03n\x03").split("\x03") if x]
            text = _cat(*[F.col("p_name") if x == "b" else F.col("p_size") if x == "n" else x.replace("\x01", "{").replace("\x02", "}") for x in parts])
            found = F.when(k == i, text) if found is None else found.when(k == i, text)
        return _cat(f'"{name}":', found)

    doc = F.concat(F.lit("{"), F.concat_ws(",", *[value(n, i) for i, n in enumerate(("title", "series", "year", "narrator", "authors"))]), F.lit("}"))
    doc = F.when(F.col("p_partkey") % 17 == 0, F.left(doc, F.lit(30))).otherwise(doc)
    found = p.select("p_partkey", doc.alias("doc")).select("p_partkey", F.explode(F.array(loose.identity(F.col("doc")))).alias("i")).filter("i IS NOT NULL")
    return found.select("p_partkey", "i.title", "i.series", "i.year", "i.narrator", F.array_join("i.authors", "|").alias("authors"))


@query("""
SELECT p_partkey, '{"title":"' || p_name || '","authors":["' || p_brand || '"]' || CASE WHEN p_size > 25 THEN ',"series":"' || p_type || '","seriesIndex":"' || p_size || '"' ELSE '' END || CASE WHEN p_partkey % 3 > 0 THEN ',"isbn":"' || CASE WHEN p_partkey % 3 = 1 THEN '978' ELSE '' END || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '"' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN ',"coverUrl":"https://x/' || p_size || '.jpg"' ELSE '' END || '}' AS doc FROM part""")
def sidecar_documents(spark, d):
    """K1, K5: sidecars written; the long code or else the short one, the first cover, nothing blank."""
    p, none = table(spark, d, "part"), F.lit(None).cast("string")
    k, big = F.col("p_partkey") % 3, F.col("p_size") > 25
    short = F.lpad(F.col("p_partkey").cast("string"), 10, "0")
    covers = F.when(F.col("p_partkey") % 2 == 0, F.array(_cat("https://x/", F.col("p_size"), ".jpg"), F.lit("https://x/second.jpg"))).otherwise(F.array().cast("array<string>"))
    fields = {"title": F.col("p_name"), "authors": F.array("p_brand"), "series": F.when(big, F.col("p_type")).otherwise(""), "series_index": F.when(big, F.col("p_size").cast("string")), "year": F.lit(0).cast("long"), "isbn_13": F.when(k == 1, F.concat(F.lit("978"), short)),
              "isbn_10": F.when(k > 0, short), "cover_urls": covers, **{n: none for n in ("narrator", "asin", "description", "publisher", "language")}}
    i = F.struct(*[c.alias(n) for n, c in fields.items()])
    return p.select("p_partkey", i.alias("i")).select("p_partkey", loose.document(F.col("i")).alias("doc"))


@query("""
WITH p AS (SELECT *, p_partkey % 6 AS m FROM part)
SELECT p_partkey, CASE WHEN m = 5 THEN p_name || ' & more' ELSE p_name END AS title, CASE WHEN m = 5 THEN p_brand || '|Bo' ELSE p_brand END AS authors, CASE m WHEN 2 THEN '' WHEN 5 THEN 'aut|nrt' ELSE 'aut' END AS roles, CASE WHEN m <> 2 OR p_size > 25 THEN p_type END AS series,
  CASE WHEN m <> 2 OR p_size > 25 THEN p_size || '.0' END AS series_index, CAST(1990 + p_size % 30 AS INTEGER) AS year, CASE WHEN m = 5 THEN 'Ann N.' END AS narrator, CASE WHEN m = 1 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'X' END AS isbn_10,
  CASE WHEN m IN (0, 5) THEN '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS isbn_13, CASE WHEN m = 5 THEN lpad(CAST(p_partkey AS VARCHAR), 10, 'B') END AS asin FROM p WHERE m NOT IN (3, 4)""")
def package_identities(spark, d):
    """S9, P-X1: package documents by namespace under any prefix, roles, identifiers by scheme, name and content pairs; broken ones and those without a title give nothing."""
    p = table(spark, d, "part")
    m, key, size = F.col("p_partkey") % 6, F.col("p_partkey"), F.col("p_size")
    year = _cat(1990 + size % 30, "-02-03")

    def package(dc, opf, title, more, mark):
        e, o = (f"{x}:" if x else "" for x in (dc, opf))
        spaces = (f' xmlns:{dc}="{packages.DC}"' if dc else "") + (f" xmlns:{opf or mark}='{packages.OPF}'" if mark else "") + (f' xmlns="{packages.OPF}"' if mark and not opf else "")
        role = f' {mark}:role="aut" {mark}:file-as="x"' if mark else ""
        pairs = _cat(f'<{o}meta name="calibre:series" content="', F.col("p_type"), f'"/><{o}meta content="', size, f'.0" name="calibre:series_index"></{o}meta><{o}meta property="x">no</{o}meta>')
        pairs = pairs if mark else F.when(size > 25, pairs).otherwise("")
        head = _cat(f"<?xml version='1.0' encoding='utf-8'?>\n<{o}package{spaces}><{o}metadata>")
        return _cat(head, title, f"<{e}creator{role}> ", F.col("p_brand"), f"</{e}creator>", f"<{e}date>", year, f"</{e}date>", pairs, more, f"</{o}metadata></{o}package>")

    code = lambda e, mark, scheme, c: _cat(f'<{e}:identifier {mark}:scheme="{scheme}">', c, f"</{e}:identifier>")
    long = _cat("978-", F.lpad(key.cast("string"), 10, "0"))
    titled = lambda e, c: _cat(f"<{e}title>", c, f"</{e}title>")
    usual = package("dc", "", titled("dc:", F.col("p_name")), code("dc", "opf", "ISBN", long), "opf")
    other = package("d", "o", titled("d:", F.col("p_name")), code("d", "o", "isbn13", _cat(F.lpad(key.cast("string"), 9, "0"), "-x")), "o")
    bare = package("", "", titled("", F.col("p_name")), _cat("<identifier scheme=\"ISBN\">", long, "</identifier>"), "")
    rich = _cat('<dc:creator opf:role="nrt">Bo</dc:creator><dc:creator/>', code("dc", "opf", "ISBN", "no code"), code("dc", "opf", "isbn", long), code("dc", "opf", "Asin", _cat(" ", F.lpad(key.cast("string"), 10, "B"))), '<meta name="calibre:narrator" content="Ann"/><meta name="calibre:narrator" content="Ann N."/>')
    full = package("dc", "", titled("dc:", _cat(F.col("p_name"), " &amp; more")), rich, "opf")
    doc = F.when(m == 0, usual).when(m == 1, other).when(m == 2, bare).when(m == 3, F.left(usual, F.length(usual) - 12)).when(m == 4, package("dc", "", _cat("<dc:title> </dc:title>"), "", "opf")).otherwise(full)
    found = p.select("p_partkey", doc.alias("doc")).select("p_partkey", F.explode(F.array(packages.identity(F.col("doc")))).alias("i")).filter("i IS NOT NULL")
    return found.select("p_partkey", "i.title", F.array_join("i.authors", "|").alias("authors"), F.array_join("i.roles", "|").alias("roles"), "i.series", "i.series_index", "i.year", "i.narrator", "i.isbn_10", "i.isbn_13", "i.asin")
