"""Checks and summaries of the ordered tracks of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_issues(df: DataFrame, key: str, index: str) -> DataFrame:
    """Missing and repeated numbers of each set's 1..n numbering."""
    g = df.groupBy(key).agg(F.array_sort(F.collect_list(index)).alias("have"))
    g = g.withColumn("n", F.size("have")).withColumn("distinct_n", F.size(F.array_distinct("have")))
    want = F.sequence(F.lit(1), F.col("n"))
    g = g.withColumn("missing", F.array_sort(F.array_except(want, F.col("have"))))
    return g.select(key, F.col("n").cast("long").alias("n"), (F.col("distinct_n") < F.col("n")).alias("has_duplicates"), F.concat_ws(",", F.transform("missing", lambda x: x.cast("string"))).alias("missing"))


# What is said of a disc's numbering.
GAPS, TWICE = "Disc {} has gaps in track numbering: {}", "Disc {} has duplicate track numbers: {}"


def numbering_warnings(df: DataFrame, key: str, disc: str, index: str) -> DataFrame:
    """(key, warnings): of each disc in order, numbers that aren't 1 to n, and all that stand more than once; sets without any have none.

    A disc's numbers are gathered, some hundreds at most.
    """
    g = df.groupBy(key, F.col(disc).alias("disc")).agg(F.array_sort(F.collect_list(index)).alias("have"))
    n = F.size("have")
    shown = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(xs, lambda x: x.cast("string")), ", "), F.lit("]"))
    said = lambda form, xs: F.concat(F.lit(form.split("{}")[0]), F.col("disc").cast("string"), F.lit(form.split("{}")[1]), shown(xs))
    twice = F.filter("have", lambda x: F.size(F.filter("have", lambda y: y == x)) > 1)
    gaps = F.when((n > 1) & (F.col("have") != F.transform(F.sequence(F.lit(1), n), lambda i: i.cast(dict(df.dtypes)[index]))), said(GAPS, F.col("have")))
    g = g.select(key, "disc", F.array_compact(F.array(gaps, F.when(F.size(twice) > 0, said(TWICE, twice)))).alias("said"))
    return g.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("disc", "said"))), lambda x: x["said"])).alias("warnings"))


def totals(df: DataFrame, key: str, duration: str, disc: str) -> DataFrame:
    """Tracks, discs (one at least) and duration (null if none) of each set."""
    return df.groupBy(key).agg(F.count("*").alias("n_tracks"), F.greatest(F.count_distinct(disc), F.lit(1)).alias("n_discs"), F.nullif(F.sum(duration), F.lit(0)).alias("duration"))


def outliers(df: DataFrame, key: str, value: str, share: float = 0.25) -> DataFrame:
    """Rows whose value is off their set's mean by more than the share of it."""
    mean = F.avg(value).over(Window.partitionBy(key))
    return df.withColumn("mean", mean).filter((F.col("mean") > 0) & (F.abs(F.col(value) - F.col("mean")) > share * F.col("mean")))


def inconsistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sets of two or more rows that disagree on some column, with the values."""
    # The sets give both the values and their number, so no distinct aggregate expands the rows.
    g = df.groupBy(key).agg(F.count("*").alias("n"), *[F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(c) for c in columns])
    several = F.greatest(*[F.size(c) for c in columns], F.lit(0)) > 1
    return g.filter((F.col("n") > 1) & several).select(key, *[F.concat_ws(",", c).alias(c) for c in columns])


def series_gaps(df: DataFrame, series: str, volume: str) -> DataFrame:
    """Whole volumes missing between the first and last that a series has."""
    v = F.col(volume).try_cast("int")
    g = df.filter(v.isNotNull() & F.col(series).isNotNull()).groupBy(F.lower(F.trim(series)).alias("series")).agg(F.collect_set(v).alias("have"))
    missing = F.array_sort(F.array_except(F.sequence(F.array_min("have"), F.array_max("have")), F.col("have")))
    return g.select("series", F.size("have").cast("long").alias("n_have"), F.concat_ws(",", F.transform(missing, lambda x: x.cast("string"))).alias("missing")).filter("missing <> ''")


def chapter_offsets(df: DataFrame, key: str, order: list[str], ms: str) -> DataFrame:
    """Start and end of each chapter, from the lengths of those before it."""
    w = Window.partitionBy(key).orderBy(*order)
    start = F.coalesce(F.sum(ms).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return df.withColumn("ord", F.row_number().over(w)).withColumn("start_ms", start).withColumn("end_ms", F.when(F.col(ms) > 0, F.col("start_ms") + F.col(ms)))


def chapter_ends(df: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """Each chapter ends where the next starts; the last has no end."""
    return df.withColumn("end_ms", F.lead(start).over(Window.partitionBy(key).orderBy(start, tie)))


def silence_breaks(df: DataFrame, key: str, start: str, end: str, least: float = 3.0, gap: float = 60.0) -> DataFrame:
    """Midpoints of silences, each at least ``gap`` after the last accepted one.

    The choice depends on the one before, so it is a fold over each key's midpoints
    in order, not a window frame.  Silences may overlap, so one that starts later
    may have the earlier midpoint.
    """
    silences = df.select(key, F.when(F.col(end) - F.col(start) >= least, (F.col(start) + F.col(end)) / 2).alias("mid"))
    fold = F.aggregate(
        "mids",
        F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("cuts")),
        lambda acc, x: F.when(x - acc["last"] >= gap, F.struct(x.alias("last"), F.concat(acc["cuts"], F.array(x)).alias("cuts"))).otherwise(acc),
        lambda acc: acc["cuts"],
    )
    return silences.groupBy(key).agg(F.array_sort(F.collect_list("mid")).alias("mids")).select(key, fold.alias("cuts"))
