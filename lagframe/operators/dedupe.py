"""Keep-first deduplication with an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, nulls first (a total order makes the result unique). A null key is one key.

    Spark limits each task's rows of a key to the first one before the shuffle (window group limit), so a key that many rows
    share is no bottleneck.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in order]))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def is_duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that several rows share, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
