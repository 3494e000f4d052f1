"""Bounded samples of labelled rows, which the classifiers are fitted on. Nothing else is ever sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

#: Characters of a sample times its number of labels, at most: work and memory of a fit grow with both.
BUDGET = 1 << 25
#: Places of a long text from which its pieces are taken.
PLACES = 4


def within(labels: int, rows: int, chars: int) -> tuple[int, int]:
    """Rows a label and characters a row, lowered so that a sample of all labels stays within the budget (to a row of 64 characters)."""
    own = BUDGET // max(1, labels) ** 2
    return max(1, min(rows, own // chars)), max(64, min(chars, own))


def stratified_ids(rows: DataFrame, label: str, n: int) -> tuple[DataFrame, DataFrame]:
    """About ``n`` ids of each label of ``rows(doc_id, label)``, and the number of ids by label.

    A label with ``n`` ids or fewer gives all of them. Of a more frequent one those go in whose hash lies under the label's
    share, so their number is ``n`` give or take a few times its square root. Nothing is ranked, so no task gets a label's
    ids. Repeated rows count once; rows without id or label are left out. A row a label is broadcast.
    """
    rows = store(rows.select("doc_id", label).where(f"doc_id is not null and {label} is not null").distinct())
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    share = counts.select(F.col(label).alias("_label"), (F.lit(float(n)) / F.col("n")).alias("_share"))
    some = rows.join(F.broadcast(share), F.col(label) == F.col("_label")).withColumn("_at", F.xxhash64("doc_id"))
    some = some.where(f"_share >= 1 or _at < least(_share, 1.0D) * {2.0**64} - {2.0**63}")
    return some.select("doc_id", label), counts


def piece(text: str, chars: int) -> Column:
    """A text of at most ``chars`` characters as it is; of a longer one pieces from places spread evenly over it."""
    length, size = F.length(text), chars // PLACES
    start = lambda i: (F.floor((length - size) * i / (PLACES - 1)) + 1).cast("int")
    return F.when(length <= chars, F.col(text)).otherwise(F.concat_ws(" ", *[F.substring(F.col(text), start(i), F.lit(size)) for i in range(PLACES)]))


def labelled_texts(docs: DataFrame, picked: DataFrame, label: str, chars: int) -> list[tuple]:
    """``(doc_id, label, piece)`` of the picked ids on the driver, sorted; of an id with several texts the smallest piece.

    Where ``docs`` has the label itself, it must be the picked one.
    """
    on = [c for c in ("doc_id", label) if c in docs.columns]
    own = docs.where("text <> ''").join(F.broadcast(picked), on)  # about n ids a label
    return sorted(tuple(r) for r in own.groupBy("doc_id", label).agg(F.min(piece("text", chars)).alias("text")).collect())
