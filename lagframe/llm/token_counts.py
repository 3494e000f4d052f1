"""Token counts: an exact length histogram whose suffix sums answer totals, quantiles and truncated totals at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as K
from .scratch import store

#: Lengths are summed in blocks of so many, then over the blocks, so that no task gets the whole histogram.
BLOCK = 4096


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens``, ``n_docs``: how many texts have each encoded length. Null texts are empty; other columns are ignored."""
    path = path or K.default_path()

    def run(batches):
        for batch in batches:
            for _, _, _, at in K.encoded(batch.column("text"), path):
                length, n = np.unique(np.diff(at), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit:

    ``n_docs`` of that length, ``docs_at_least`` and ``tokens_at_least`` in texts of that length or more,
    ``truncated_total``, the tokens left if every text is cut to the limit, ``total_docs`` and ``total_tokens`` of all, and
    ``quantile``, the share of texts not longer. Any other limit L lies between two rows: its truncated total is that of
    the next smaller length plus (L - that length) for each longer text (:func:`at_limits`). An empty histogram has no rows.

    The histogram is read twice, so it is stored: no text is encoded again.
    """
    h = store(histogram).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"))
    inner = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("block", "n_tokens", "n_docs", F.sum("n_docs").over(inner).alias("d_in"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner).alias("t_in"))
    h = h.join(blocks, "block").withColumn("docs_at_least", F.col("d_in") + F.col("d_after")).withColumn("tokens_at_least", F.col("t_in") + F.col("t_after"))
    shorter = F.col("total_tokens") - F.col("tokens_at_least")
    return h.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (shorter + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"), "total_docs", "total_tokens", ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"))


def at_limits(limits: DataFrame, contexts: list[int]) -> DataFrame:
    """``context``, ``truncated_total``, ``docs_longer`` for any context limits, from the rows of :func:`context_limits`.

    A limit that is asked for twice has one row; without rows of limits there are none. Columns other than those are ignored.
    """
    asked = limits.sparkSession.createDataFrame([(c,) for c in contexts], "context long")
    below = F.when(F.col("n_tokens") <= F.col("context"), F.struct("n_tokens", "truncated_total", (F.col("docs_at_least") - F.col("n_docs")).alias("longer")))
    row = limits.crossJoin(F.broadcast(asked)).groupBy("context").agg(F.max(below).alias("b"), F.max("total_docs").alias("all"))
    longer = F.coalesce("b.longer", "all")
    return row.select("context", (F.coalesce("b.truncated_total", F.lit(0)) + (F.col("context") - F.coalesce("b.n_tokens", F.lit(0))) * longer).alias("truncated_total"), longer.alias("docs_longer"))
