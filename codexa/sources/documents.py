"""Documents built from rows: cue sheets, OPF, chapter metadata and plans.

Each is a Column, or one row a key; ``write_texts`` puts one file a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import frames


def escape(c: Column) -> Column:
    """Text for XML."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def opf(title: Column, creator: Column, language: Column, isbn: Column) -> Column:
    """A package document; elements without a value are left out."""
    element = lambda n, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  <dc:{n}>"), escape(c), F.lit(f"</dc:{n}>")))
    body = F.concat_ws("\n", element("title", title), element("creator", creator), element("language", language), element("identifier", isbn))
    return F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>\n'), body, F.lit("\n</metadata></package>\n"))


def cue_sheets(chapters: DataFrame, key: str, title: str, start_ms: str, audio: Column) -> DataFrame:
    """(key, text): a TRACK for each chapter in order of its start."""
    rows = F.array_sort(F.collect_list(F.struct(start_ms, title)))
    line = lambda r, i: F.concat(F.lit("  TRACK "), F.lpad((i + 1).cast("string"), 2, "0"), F.lit(' AUDIO\n    TITLE "'), F.replace(r[title], F.lit('"'), F.lit("'")), F.lit('"\n    INDEX 01 '), frames(r[start_ms]))
    return chapters.groupBy(key).agg(F.concat(F.lit('FILE "'), F.first(audio), F.lit('" MP4\n'), F.array_join(F.transform(rows, line), "\n"), F.lit("\n")).alias("text"))


def ffmetadata(chapters: DataFrame, key: str, title: str, start_ms: str, end_ms: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(start_ms, end_ms, title)))
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).cast("string")
    block = lambda r: F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), number(r[start_ms]), F.lit("\nEND="), number(r[end_ms]), F.lit("\ntitle="), r[title])
    return chapters.groupBy(key).agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform(rows, block), "\n"), F.lit("\n")).alias("text"))


def plan_documents(moves: DataFrame, key: str, order: str, old: str, new: str) -> DataFrame:
    """(key, text): a plan's moves as one JSON document."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, old, new))), lambda m: F.struct(m[old].alias("old"), m[new].alias("new")))
    return moves.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias("plan"), rows.alias("operations"))).alias("text"))


def append_log(rows: DataFrame, path: str, day: Column) -> None:
    """Adds rows to a log, a folder a day."""
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """The table with each key's newest row, those of ``rows`` among them; ``rows`` win ties."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    best = F.max(F.struct(at, "__new", F.struct(*table.columns).alias("row"))).getField("row").alias("row")
    return both.groupBy(key).agg(best).select("row.*")
