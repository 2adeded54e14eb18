"""A library server's answers, of every endpoint, as rows of one shape.

An answer is read as VARIANT; its endpoint says where its rows are, wrapped in an object or as a bare list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where the rows of each endpoint's answer are, first place first; others are one row themselves.
ROWS = {"libraries": ("libraries",), "items": ("results",), "search": ("book", "books"), "collections": ("collections",)}
FIELDS = ("id", "name", "author", "progress", "seconds", "finished", "updated", "members", "total")


def answers(df: DataFrame, keys: list[str], endpoint: str, json: str) -> DataFrame:
    """(keys, endpoint, place, FIELDS) of each row in an answer; what isn't JSON, or of another shape, has none.

    ``seconds`` is a place in a book, or the time listened; ``members`` counts a collection's books,
    or the days of statistics; ``total`` counts all rows of a paged listing, or the sessions of statistics.
    """
    v = df.select(*keys, F.col(endpoint).alias("endpoint"), F.explode(F.array(F.try_parse_json(json))).alias("v"))
    is_a = lambda c, kind: F.coalesce(F.schema_of_variant(c).startswith(kind), F.lit(False))
    none = F.array().cast("array<variant>")
    listed = F.when(is_a(F.col("v"), "ARRAY") & F.col("endpoint").isin("libraries", "collections"), F.try_variant_get("v", "$", "array<variant>"))
    for name, places in ROWS.items():
        found = F.coalesce(*[F.try_variant_get("v", f"$.{p}", "array<variant>") for p in places], none)
        listed = listed.when(is_a(F.col("v"), "OBJECT") & (F.col("endpoint") == name), found)
    alone = is_a(F.col("v"), "OBJECT") & ~F.col("endpoint").isin(*ROWS)
    rows = v.select(*keys, "endpoint", "v", F.posexplode(listed.when(alone, F.array("v")).otherwise(none)).alias("place", "r"))
    rows = rows.filter(is_a(F.col("r"), "OBJECT"))
    # A hit of a search wraps its item.
    rows = rows.withColumn("r", F.when(F.col("endpoint") == "search", F.coalesce(F.try_variant_get("r", "$.libraryItem", "variant"), "r")).otherwise(F.col("r")))
    get = lambda p, kind="string": F.try_variant_get("r", f"$.{p}", kind)
    size = lambda c, p, kind: F.size(F.try_variant_get(c, f"$.{p}", kind)).cast("long")
    of = lambda name, c: F.when(F.col("endpoint") == name, c)
    count = lambda n: F.when(n >= 0, n)
    first = {
        "id": F.coalesce(get("id"), of("progress", get("libraryItemId"))), "name": F.coalesce(get("media.metadata.title"), get("title"), get("name")), "author": get("media.metadata.authorName"),
        "progress": get("progress", "double"), "seconds": F.coalesce(get("currentTime", "double"), of("stats", get("totalTime", "double"))), "finished": get("isFinished", "boolean"), "updated": get("lastUpdate"),
        "members": F.coalesce(of("collections", count(size("r", "books", "array<variant>"))), of("stats", F.coalesce(count(size("r", "days", "map<string,variant>")), F.lit(0).cast("long")))),
        "total": F.coalesce(of("items", F.try_variant_get("v", "$.total", "long")), of("stats", F.coalesce(count(size("r", "recentSessions", "array<variant>")), F.lit(0).cast("long")))),
    }
    return rows.select(*keys, "endpoint", "place", *[c.alias(n) for n, c in first.items()])


