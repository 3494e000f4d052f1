"""Text: keyword flags, delimited types, keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that mark pandemic-related articles.
PANDEMIC_TERMS = [
    "covid",
    "covid-19",
    "coronavirus disease 19",
    "sars-cov-2",
    "2019-ncov",
    "2019ncov",
    "2019-n-cov",
    "2019n-cov",
    "ncov-2019",
    "n-cov-2019",
    "coronavirus-2019",
    "wuhan pneumonia",
    "wuhan virus",
    "wuhan coronavirus",
    "coronavirus 2",
]

# Terms that mark replications.
REPLICATION_TERMS = ["replication", "replicating", "replication of", "replication study"]

# Texts that stand for a missing value.
SENTINELS = ["-", "NA", "_", ""]


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms occurs as whole words, in any case; null for null text."""
    return text.rlike(r"(?i)\b(?:" + "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms) + r")\b")


def keyword_flag(title: Column, keywords: Column, terms: list[str], null_is_false: bool = False) -> Column:
    """Whether title or keywords hold a term, three-valued: true beats null, null beats false."""
    flag = any_term(title, terms) | any_term(keywords, terms)
    return F.coalesce(flag, F.lit(False)) if null_is_false else flag


def extract_types(types: Column) -> Column:
    """``D016428:Journal Article; D013485:Review`` as ``Journal Article, Review``."""
    return F.array_join(F.regexp_extract_all(types, F.lit("(?<=:)[^;]+"), 0), ", ")


def has_text(column: Column, needle: str, null_is_false: bool = True) -> Column:
    found = column.contains(needle)
    return F.coalesce(found, F.lit(False)) if null_is_false else found


def semicolons_to_commas(text: Column) -> Column:
    return F.replace(text, F.lit(";"), F.lit(","))


def normal_issn(issn: Column) -> Column:
    """An ISSN without hyphens and blanks; sentinels and empty texts are null."""
    bare = F.regexp_replace(F.trim(issn), "-", "")
    return F.when(~bare.isin("", "NA", "_"), bare)


def quartile_number(quartile: Column) -> Column:
    """``Q1`` as 1.0; null for anything that isn't a number behind the prefix."""
    return F.regexp_replace(quartile, "^Q", "").try_cast("double")


def null_sentinels(column: Column, sentinels: list[str] | None = None) -> Column:
    return F.when(~column.isin(*(sentinels or SENTINELS)), column)


def decimal_comma(text: Column) -> Column:
    """``1,25`` as 1.25; null for anything else that is no number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def head_is(text: Column, prefix: str) -> Column:
    return text.startswith(prefix)


def after(text: Column, n: int) -> Column:
    """The text behind its first ``n`` characters."""
    return F.substring(text, F.lit(n + 1), F.length(text))
