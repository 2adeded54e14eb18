"""The corpus pipeline: documents pass through the stages in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexa.llm.decontam import decontaminate_stage
from codexa.llm.mixing import mix_stage
from codexa.llm.sharding import shard_stage
from codexa.llm.simhash import simhash_stage
from codexa.llm.store import cut, documents
from codexa.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
    ("shard", shard_stage),
]

#: Learned scores and XXH64 fingerprints aren't SQL; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the written result of the one before."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
