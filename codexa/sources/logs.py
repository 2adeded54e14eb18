"""Logs and plans as JSON documents: read leniently, listed newest first, cleaned up by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATION = "operation_id string, timestamp string, operation_type string, old_path string, new_path string"
LOG = f"transaction_id string, timestamp string, transaction_type string, operations array<struct<{OPERATION.replace(' string', ': string')}>>, __bad string"
MOVE = "track struct<src_path: string>, old_path: string, new_path: string, conflicts: array<string>"
PLAN = "plan_id string, source_path string, created_at string, operations array<struct<old_path: string, new_path: string>>, conflicts array<string>, warnings array<string>, __bad string"
LENIENT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, body) of the files under a path that Spark reads, each whole."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("body"))


def parsed(docs: DataFrame, body: str, schema: str) -> DataFrame:
    """Adds ``doc``; documents that aren't JSON of such a shape are left out.

    A generator's column isn't written out again in the filters above it, so each document is parsed once.
    """
    return docs.select("*", F.explode(F.array(F.from_json(body, schema, LENIENT))).alias("doc")).filter("doc IS NOT NULL AND doc.__bad IS NULL")


def kind_of(doc: Column, path: Column, quarantine: str = ".quarantine") -> Column:
    """What a log says of itself; else a cleaning of copies if it or a target lies in quarantine, else a renaming."""
    moved = F.exists(doc["operations"], lambda o: F.coalesce(o["new_path"].contains(quarantine), F.lit(False)))
    return F.coalesce(F.nullif(doc["transaction_type"], F.lit("")), F.when(F.coalesce(moved, F.lit(False)) | path.contains(quarantine), "dedupe").otherwise("rename"))


def transactions(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(id, timestamp, transaction_type, operation_count, can_undo, status) of (path, modified, body) logs.

    Logs older than so many days aren't listed, taken-back ones (``.undone``)
    always; those without an id, a time or operations are passed over.  The
    list is shown by time, newest first.
    """
    undone = F.col("path").endswith(".undone")
    rows = parsed(logs, "body", LOG).filter(undone | (F.col("path").endswith(".json") & (F.col("modified") >= now - F.make_dt_interval(F.lit(days)))))
    d = F.col("doc")
    rows = rows.filter(d["transaction_id"].isNotNull() & d["timestamp"].isNotNull() & d["operations"].isNotNull())
    return rows.select(
        d["transaction_id"].alias("id"), d["timestamp"].alias("timestamp"), kind_of(d, F.col("path")).alias("transaction_type"), F.size(d["operations"]).alias("operation_count"),
        (~undone).alias("can_undo"), F.when(undone, "undone").alias("status"),
    )


def outdated(logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Logs of any kind that are older than so many days, for a sink to delete."""
    return logs.filter(F.col("modified") < now - F.make_dt_interval(F.lit(days)))


def plans(docs: DataFrame) -> DataFrame:
    """(plan_id, place, old_path, new_path) of (body) plan documents, moves in their order; what isn't a plan is left out."""
    rows = parsed(docs, "body", PLAN).filter("doc.plan_id IS NOT NULL AND doc.operations IS NOT NULL")
    return rows.select(F.col("doc.plan_id").alias("plan_id"), F.posexplode("doc.operations").alias("place", "o")).select("plan_id", "place", "o.old_path", "o.new_path")
