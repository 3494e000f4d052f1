"""Rows to columns and back, split values, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagframe.functions.text import normal_issn, null_sentinels


def canonical_columns(df: DataFrame) -> DataFrame:
    """Names in lower case with ``_`` for blanks; of equal names the first column stays."""
    names = [c.lower().replace(" ", "_") for c in df.columns]
    first = [names.index(n) == i for i, n in enumerate(names)]
    renamed = df.toDF(*[f"{n}" if f else f"_dropped_{i}" for i, (n, f) in enumerate(zip(names, first, strict=True))])
    return renamed.select(*[f"`{n}`" for n, f in zip(names, first, strict=True) if f])


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names that a regular expression finds something in, in any case."""
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*columns_like(df, pattern))


def null_sentinels_everywhere(df: DataFrame) -> DataFrame:
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    return df.select(*[null_sentinels(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


def split_rows(df: DataFrame, column: str, delimiter: str, keep_null: bool = True) -> DataFrame:
    """One row for each part of a delimited text; a null text keeps its row unless told otherwise."""
    parts = F.split(F.col(column), re.escape(delimiter), -1)
    return df.withColumn(column, F.explode_outer(parts) if keep_null else F.explode(parts))


def issn_keys(df: DataFrame, print_issn: str, online_issn: str, key: str = "issn_linking") -> DataFrame:
    """One row for each of the two ISSNs that is there, without hyphens; rows with neither go, equal ones count once."""
    keys = F.array_distinct(F.array_compact(F.array(normal_issn(F.col(print_issn)), normal_issn(F.col(online_issn)))))
    return df.withColumn(key, F.explode(keys))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns, or a row for each struct of an array (empty arrays give none)."""
    if df.schema[column].dataType.typeName() == "array":
        return df.withColumn(column, F.explode(column)).select(*[c for c in df.columns if c != column], f"{column}.*")
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str, prefix: str = "") -> DataFrame:
    """A row for each id and column; the name loses its prefix."""
    out = df.unpivot(ids, columns, name, value)
    return out.withColumn(name, F.regexp_replace(name, f"^{re.escape(prefix)}", "")) if prefix else out


def long_to_wide(df: DataFrame, key: str, year: str, years: list[int], values: list[str], base_year: int | None = None, base_value: str | None = None) -> DataFrame:
    """Year-indexed columns ``<value>_<year>`` of the first value by key and year; with ``base_year`` only keys of that year,
    and with ``base_value`` only those that have this column's value there.

    One shuffle, with conditional aggregates instead of a join for each year.
    """
    cells = [F.max(F.when(F.col(year) == y, F.col(v))).alias(f"{v}_{y}") for v in values for y in years]
    has = [] if base_year is None else [F.bool_or((F.col(year) == base_year) & (F.lit(True) if base_value is None else F.col(base_value).isNotNull())).alias("_base")]
    out = df.groupBy(key).agg(*cells, *has)
    return out if base_year is None else out.where("_base").drop("_base")


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_ordinal(df: DataFrame) -> DataFrame:
    """Where each row of a file scan stands, for keep-first: ``file``, ``block`` (the first byte of its part of the file) and
    ``ordinal``, which rises within a part. In this order rows are as listed, however the scan was split."""
    return df.withColumns({"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "ordinal": F.monotonically_increasing_id()})
