"""Sinks: partitioned article tables and small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagframe.schema import ARTICLE_COLUMNS


#: Rows of one file of articles, at most.
FILE_ROWS = 5_000_000


def write_articles(df: DataFrame, path: str, date: str = "article_date", replace: bool = False, rows: int = FILE_ROWS) -> None:
    """Parquet by year of the article, at a new path: an input is never overwritten.

    With ``replace`` the years that ``df`` has are overwritten at a path that may be there, and other years stay, so that a rerun
    writes the same again. Rows are rebalanced by year before they are written: a year is in few files however many tasks there
    were, and a large year in several, of ``rows`` rows at most.
    """
    out = df.withColumn("article_year", F.year(date)).hint("rebalance", "article_year").write.partitionBy("article_year").option("maxRecordsPerFile", rows)
    if replace:
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def write_processed(df: DataFrame, path: str) -> None:
    """Processed articles as tab-separated text with a header, for :func:`~lagframe.sources.readers.read_processed`; a missing value
    is ``NA``."""
    df.select(ARTICLE_COLUMNS).write.option("header", True).option("sep", "\t").option("nullValue", "NA").option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str, order: list[str] | None = None, row_number: bool = False) -> None:
    """A small result table as one CSV file with a header, sorted, with row numbers if wanted."""
    if row_number:
        df = df.withColumn("row", F.row_number().over(Window.orderBy(*(order or df.columns)))).select("row", *df.columns)
    df = df.orderBy(*order) if order else df
    df.coalesce(1).write.option("header", True).option("nullValue", "NA").csv(path)
