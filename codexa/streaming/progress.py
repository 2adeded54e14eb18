"""Playback progress: last writer wins, in batch and on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def latest(events: DataFrame, key: str, at: str, order: str, values: list[str]) -> DataFrame:
    """Each key's newest row; of rows with one time, the first by order."""
    best = F.max_by(F.struct(*values), F.struct(F.col(at), -F.col(order)))
    return events.groupBy(key).agg(F.max(at).alias(at), best.alias("v")).select(key, at, "v.*")


def merge(local: DataFrame, server: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Server rows replace local ones only if strictly newer."""
    a, b = local.alias("a"), server.alias("b")
    newer = F.col(f"b.{at}").isNotNull() & (F.col(f"a.{at}").isNull() | (F.col(f"b.{at}") > F.col(f"a.{at}")))
    pick = lambda c: F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, key, "full_outer").select(key, pick(at), *[pick(v) for v in values], newer.alias("pulled"))


def stream_latest(events: DataFrame, key: str, at: str, order: str, values: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """The same as a running aggregate: one row of state a key."""
    state = latest(events, key, at, order, values)
    return state.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pushed(rows: DataFrame, refused: Column, idle: Column) -> DataFrame:
    """Adds ``error`` and ``synced``: a row that the server refuses, or that has nothing to tell, keeps an error and is tried again."""
    error = F.when(refused, "refused").when(idle, "no progress")
    return rows.withColumn("error", error).withColumn("synced", error.isNull())


def _versions(spark, place: str) -> list[int]:
    """Numbers of the whole versions in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def to_end(writer: DataStreamWriter) -> None:
    """Runs a stream over what its source has now."""
    writer.trigger(availableNow=True).start().awaitTermination()


def merge_stream(events: DataFrame, key: str, at: str, order: str, values: list[str], place: str, run: Callable[[DataStreamWriter], None] = to_end) -> DataFrame:
    """Runs a stream to its end; its table of each key's newest row.

    Every micro-batch writes a version under its number, from the whole version
    before it and its own newest rows.  A batch that runs again, after a lost
    executor or a new start on the same folder, writes the same version again.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        rows = latest(batch, key, at, order, values)
        if older := [v for v in _versions(spark, place) if v < number]:
            rows = merge(spark.read.parquet(f"{place}/version={older[-1]}"), rows, key, at, values).drop("pulled")
        rows.write.mode("overwrite").parquet(f"{place}/version={number}")

    run(events.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint"))
    if not (whole := _versions(spark, place)):
        return latest(spark.createDataFrame([], events.schema), key, at, order, values)
    return spark.read.parquet(f"{place}/version={whole[-1]}")


def count_stream(events: DataFrame, by: list[str], place: str) -> DataFrame:
    """Runs a stream to its end; its rows counted by key.

    Every micro-batch writes its own counts under its number, and they are summed
    at the end: rows count however late they come.  A batch that runs again writes
    the same counts again.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/version={number}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = events.select(*by).schema.add("n", "long")
    whole = [f"{place}/version={v}" for v in _versions(spark, place)]
    rows = spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)
    return rows.groupBy(*by).agg(F.sum("n").alias("n"))
