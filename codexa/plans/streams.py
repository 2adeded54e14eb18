"""Queries that run as streams over the event table, each to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_shared
from ..sources.tables import table
from ..streaming import progress, watch
from .queries import query

#: Pages that a batch may take if as many were read before: a merge sorts what doesn't fit in memory, but a key's rows of a batch meet in one state.
CATCH_UP, KEPT_UP = 100_000, 512


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return f"{ensure_shared(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # A stream reads folders, or names by pattern.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
SELECT user_id, ts AS stamp, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def stream_progress(spark, d):
    """ST1, ST2, ST3, K11: each micro-batch merges into the table of newest rows, then is marked as pushed."""
    place = _folder(spark)
    events = _events(spark, d).select("user_id", F.col("ts").alias("stamp"), "event_id", "value")
    return progress.merge_stream(events, "user_id", "stamp", "event_id", ["event_id", "value"], place).select("user_id", "stamp", "event_id", "value")


@query("""
SELECT date_trunc('day', ts) AS day_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily(spark, d):
    """A30 on a stream: counts by day, each micro-batch's own, summed at its end."""
    days = _events(spark, d).select(F.date_trunc("day", "ts").alias("day_start"), "event_type")
    return progress.count_stream(days, ["day_start", "event_type"], _folder(spark))


@query("""
SELECT user_id, max(epoch_us(ts)) AS stamp, arg_max(event_id, (ts, -event_id)) AS event_id, arg_max(value, (ts, -event_id)) AS value FROM events GROUP BY user_id""")
def watched_progress(spark, d):
    """ST1, S22: a server's pages of updates, watched in batches of a few pages, each merged into the table of newest rows."""
    place = _folder(spark)
    rows = table(spark, d, "events").select("user_id", F.unix_micros("ts").alias("stamp"), "event_id", "value")
    watch.write_pages(rows, f"{place}/server", ["stamp", "event_id"], 2000)
    stream = watch.watch(spark, f"{place}/server", rows.schema, "stamp", catch_up=CATCH_UP)
    return progress.merge_stream(stream, "user_id", "stamp", "event_id", ["event_id", "value"], place, watch.drain).select("user_id", "stamp", "event_id", "value")


@query("""
WITH e AS (SELECT event_type || '|' || user_id % 20 AS key, event_id AS ord, epoch_us(ts) AS stamp, event_id % 3 = 0 AS asks, CASE event_type WHEN 'click' THEN 86400000000 WHEN 'view' THEN 43200000000 END AS ttl, CAST(user_id AS VARCHAR) AS response FROM events),
w AS (SELECT *, last_value(CASE WHEN NOT asks THEN {'at': stamp, 'ttl': ttl, 'response': response} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY stamp, asks, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM e)
SELECT key, ord, stamp, coalesce(entry IS NOT NULL AND (entry.ttl IS NULL OR stamp <= entry.at + entry.ttl), FALSE) AS hit, CASE WHEN entry IS NOT NULL AND (entry.ttl IS NULL OR stamp <= entry.at + entry.ttl) THEN entry.response END AS response FROM w WHERE asks""")
def expiring_answers(spark, d):
    """ST4: a cache on a stream, whose entries last as long as their source says; each request's answer."""
    place, kind = _folder(spark), F.col("event_type")
    ttl = F.create_map(*[x for k, h in (("click", 24), ("view", 12)) for x in (F.lit(k), F.lit(h * 3_600_000_000))])
    asks = F.col("event_id") % 3 == 0
    rows = table(spark, d, "events").select(
        F.concat_ws("|", kind, (F.col("user_id") % 20).cast("string")).alias("key"), F.col("event_id").alias("ord"), F.col("ts").alias("at"), F.unix_micros("ts").alias("stamp"), asks.alias("asks"),
        F.try_element_at(ttl, kind).alias("ttl"), F.when(~asks, F.col("user_id").cast("string")).alias("response"),
    )
    watch.write_pages(rows, f"{place}/server", ["stamp", "ord"], 2000)
    return watch.run_expiring(watch.watch(spark, f"{place}/server", rows.schema, "stamp", catch_up=KEPT_UP), place)
