"""Dates: tolerant parsing, differences in days, floors and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_partial_date(text: Column) -> Column:
    """``2020``, ``2020-03`` or ``2020-03-04`` as a date, missing parts as 1; anything else is null."""
    return F.when(text.rlike("^[0-9]{4}(-[0-9]{1,2}){0,2}$"), text.try_cast("date"))


def parse_us_timestamp(text: Column) -> Column:
    """``3/14/2020 0:00`` (month first) as a date; anything else is null."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")).cast("date")


def delay_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def publication_delay(accepted: Column, article_date: Column, pubdate: Column | None = None) -> Column:
    """Days from acceptance to the article's own date, or to the issue's date where it has none."""
    return F.datediff(article_date if pubdate is None else F.coalesce(article_date, pubdate), accepted)


def floor_month(date: Column) -> Column:
    return F.trunc(date, "month")


def floor_year(date: Column) -> Column:
    return F.trunc(date, "year")


def year_label(date: Column, keep_null: bool = False) -> Column:
    """The year as text; with ``keep_null`` a missing date is the label ``NA``, a group of its own."""
    label = F.year(date).cast("string")
    return F.coalesce(label, F.lit("NA")) if keep_null else label


def month_label(date: Column) -> Column:
    """First of the month without a leading zero, as ``2016-1-01``; it sorts as text. Null for a missing date."""
    return F.when(date.isNotNull(), F.concat_ws("-", F.year(date), F.month(date), F.lit("01")))
