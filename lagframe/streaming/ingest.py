"""Incremental ingest: a file stream takes in what has landed, in lots, and keeps a ledger of it by file name."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagframe.sources.landed import PIECE

#: Bytes of files that one lot takes in, about (a larger file is a lot of its own).
LOT_BYTES = 64 << 30
_LEDGER = "name string, path string, n long, batch long"


def _name(path: str = "path"):
    return F.regexp_extract(F.url_decode(path), "([^/]+)$", 1)


def _written(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``name``, ``path``, ``n`` (rows read), ``batch`` of each file that has been taken in."""
    path = f"{checkpoint}/files"
    return spark.read.schema(_LEDGER).parquet(path) if _written(spark, path) else spark.createDataFrame([], _LEDGER)


def ingest_new(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, fmt: str = "parquet", lot: int = LOT_BYTES, **options
) -> int:
    """Process the files that have landed in ``source`` since the last call, add them to ``target``, and stop; rows read.

    A file counts once by its base name, wherever in ``source`` it lies: of equal names in one lot the least path counts. Each lot is written as
    ``target``'s partition ``batch`` and as the ledger's, both overwritten by the lot's number, so a run that was killed repeats its
    last lot whole and adds nothing twice. A file that can't be read is left out (of one that breaks midway the rows before
    the break are taken) and the others land; :func:`set_aside` tells which gave no rows. ``transform`` keeps rows apart: it sees one lot.
    """
    stream = spark.readStream.format(fmt).schema(schema).options(**{"fileNameOnly": True, "maxBytesPerTrigger": lot, "ignoreCorruptFiles": True, **options}).load(source)
    stream = stream.withColumn("_file", F.col("_metadata.file_path"))
    taken = []

    def land(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        rows.write.mode("overwrite").parquet(staged := f"{checkpoint}/staged")
        rows = own.read.schema(rows.schema).parquet(staged)
        seen = rows.groupBy(F.col("_file").alias("path")).agg(F.count("*").alias("n")).withColumn("name", _name())
        first = seen.groupBy("name").agg(F.min_by(F.struct("path", "n"), "path").alias("f")).select("name", "f.*")  # a row a file of the lot
        new = first.join(ledger(own, checkpoint).where(F.col("batch") != batch).select("name"), "name", "left_anti")
        new.withColumn("batch", F.lit(batch)).select("name", "path", "n", "batch").write.mode("overwrite").parquet(f"{checkpoint}/files/lot={batch}")
        mine = ledger(own, checkpoint).where(F.col("batch") == batch)
        kept = rows.join(mine.select(F.col("path").alias("_file")), "_file", "left_semi").drop("_file")
        transform(kept).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        taken.append(mine.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sum(taken)


def _empty_tables(files: DataFrame) -> DataFrame:
    """``path`` of the Parquet files that are whole and hold no row, of up to ``PIECE`` bytes: such a file is little but its footer."""

    def run(batches):
        for batch in batches:
            found = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    if pq.ParquetFile(pa.BufferReader(content.as_buffer())).metadata.num_rows == 0:
                        found.append(path)
                except (pa.ArrowException, OSError):  # no table
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    marks = F.expr("substring(content, 1, 4) = X'50415231' and substring(content, -4, 4) = X'50415231'")
    return files.where(F.col("length") <= PIECE).where(marks).select("path", "content").mapInArrow(run, "path string")


def set_aside(spark: SparkSession, source: str, checkpoint: str, **options) -> DataFrame:
    """``path``, ``name``, ``length``, ``empty`` of the files in ``source`` that have been met and gave no row.

    ``empty`` tells a whole Parquet file without rows from a broken file. Files are compared by name, and those of up to ``PIECE`` bytes are
    read for it; a longer one isn't taken for empty. ``options`` are those of a file listing (``pathGlobFilter``, ``recursiveFileLookup``).
    """
    landed = spark.read.format("binaryFile").options(**options).load(source)
    none = landed.select("path", "length").withColumn("name", _name()).join(ledger(spark, checkpoint).select("name"), "name", "left_anti")
    empty = _empty_tables(landed).withColumn("empty", F.lit(True))
    return none.join(empty, "path", "left").select("path", "name", "length", F.coalesce("empty", F.lit(False)).alias("empty"))
