"""Tables between jobs: written to the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, ensure_shared  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """The frame, marked for broadcast only if it has at most so many rows.

    The frame must be cut or cheap: the check counts up to ``rows + 1`` rows.
    """
    fits = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if fits else df), fits


def park(df: DataFrame):
    """The frame as Parquet in the shared folder, and a function that deletes it.

    For tables too large to lie uncompressed in a checkpoint, and that no later
    frame reads once the next one is cut.
    """
    spark = df.sparkSession
    path = f"{ensure_shared(spark)}/parked-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), drop


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Frames made within free their exchanges' files as soon as they have run.

    Else those of each job lie on disk until the driver happens to collect its
    garbage, beside those of the next.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def apart(docs: DataFrame, keep: tuple[str, ...]):
    """The frame with neutral names for all columns but those to keep, and a function that restores them.

    So no column that an operator adds, or joins on, clashes with one of the input's.
    """
    names = docs.columns
    inner = [c if c in keep else f"__column_{i}" for i, c in enumerate(names)]
    back = dict(zip(inner, names, strict=True))
    return docs.toDF(*inner), lambda out: out.toDF(*[back.get(c, c) for c in out.columns])
