"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lagframe.sources.shared import delete_at_end, shared_dir


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Spark settings (``__`` for a dot) for the jobs run inside."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage is cut, and a lost executor costs a reread.

    The table replaces its query's shuffle files, so Spark may delete those at once instead of when the driver collects
    garbage. It goes with :func:`drop`, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagframe-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def store_filtered(df: DataFrame) -> DataFrame:
    """:func:`store` for a join of whole texts with a stored table of some ids: Spark may put its own Bloom filter of the ids,
    which has a fixed size, in front of the texts' shuffle. Spark does so where the ids' side has a condition on its rows."""
    size = "spark__sql__optimizer__runtime__bloomFilter__"
    with settings(df.sparkSession, **{f"{size}enabled": "true", f"{size}applicationSideScanSizeThreshold": "1", f"{size}creationSideThreshold": "1t"}):
        return store(df)


def drop(*frames: DataFrame | None) -> None:
    """Delete tables made by :func:`store` that nothing reads any more."""
    for df in frames:
        if df is not None:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
