"""Row filters; a null in a condition drops the row unless stated otherwise."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the columns have a value."""
    return df.dropna(subset=list(columns))


def date_order(df: DataFrame, received: str = "received", accepted: str = "accepted", article: str = "article_date") -> DataFrame:
    """Received before accepted, both before the article's date."""
    return df.where((F.col(received) < F.col(article)) & (F.col(accepted) < F.col(article)) & (F.col(accepted) > F.col(received)))


def sane_delays(df: DataFrame, first: str = "acceptance_delay", second: str = "publication_delay") -> DataFrame:
    """At least one delay is known and none is negative."""
    a, b = F.col(first), F.col(second)
    return df.where((a.isNotNull() | b.isNotNull()) & (F.coalesce(a, F.lit(0)) >= 0) & (F.coalesce(b, F.lit(0)) >= 0))


def of_type(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.where(F.col(column).contains(needle))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def recent_non_conference(df: DataFrame, since: str = "2013-01-01") -> DataFrame:
    """No conference series, received on or after a day. A row without the flag goes, so a left join before this is an inner one."""
    return df.where((F.col("is_conference") == 0) & (F.col("received") >= F.lit(since).cast("date")))


def not_ceased(df: DataFrame, max_year: int) -> DataFrame:
    """Journals still running, or ceased by ``max_year``."""
    return df.where(F.col("ceased").isNull() | (F.col("ceased") <= max_year))


def retraction_window(df: DataFrame, retracted_since: str = "2015-01-01", published_since: str = "2013-01-01") -> DataFrame:
    return df.where((F.col("retraction_date") >= F.lit(retracted_since).cast("date")) & (F.col("original_date") >= F.lit(published_since).cast("date")))


def analysis_window(df: DataFrame, since: str | datetime.date = "2016-01-01", until: str | datetime.date = "2025-06-01", least: int = 1, most: int = 1095) -> DataFrame:
    """Both delays in [least, most] and the article's date in [since, until]."""
    dates = F.col("article_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))
    return df.where(F.col("acceptance_delay").between(least, most) & F.col("publication_delay").between(least, most) & dates)
