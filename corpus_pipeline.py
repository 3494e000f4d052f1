"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagframe.llm import stages
from lagframe.llm.scratch import drop, store

STAGES = stages.STAGES

#: None: a trained classifier, an iterative fit and byte-pair ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
        drop(before)  # nothing reads the stage before any more
        before = docs
    return docs
