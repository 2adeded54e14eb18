"""Tables between jobs: written to the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_shared(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir; one is made only where the session has none, and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: later jobs read files that survive a lost executor."""
    ensure_shared(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(spark: SparkSession) -> int:
    """Parts for rows whose work is far more than their size tells: a number that is given isn't lowered by the planner."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
