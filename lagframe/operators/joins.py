"""Equi-joins of the enrichment chain. Sizes decide about broadcasting; no hint is given for tables that may grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_enrich(df: DataFrame, dim: DataFrame, on: str | list[str], suffix: str) -> DataFrame:
    """Left join; the dimension's columns whose names are taken get the suffix."""
    keys = [on] if isinstance(on, str) else on
    clash = {c: f"{c}{suffix}" for c in dim.columns if c in df.columns and c not in keys}
    return df.join(dim.withColumnsRenamed(clash), keys, "left")


def enrich_chain(df: DataFrame, dims: list[tuple[DataFrame, str]], on: str | list[str]) -> DataFrame:
    """Left joins with (dimension, suffix) pairs, each unique on the key."""
    for dim, suffix in dims:
        df = left_enrich(df, dim, on, suffix)
    return df


def year_lookup(df: DataFrame, dim: DataFrame, key: str, year: Column, last_year: int, columns: list[str], clamp: bool = True) -> DataFrame:
    """Point-in-time attributes: those of (key, year) in a long dimension ``(key, year, ...)``; years after the last one take
    the last one's with ``clamp``. Other years have nulls."""
    wanted = dim.select(F.col(key).alias("_k"), F.col("year").alias("_y"), *columns)
    asked = df.withColumn("_year", F.when(year > last_year, last_year).otherwise(year) if clamp else year)
    return asked.join(wanted, (F.col(key) == F.col("_k")) & (F.col("_year") == F.col("_y")), "left").drop("_k", "_y", "_year")


#: Parts over which rows with a null key are dealt in a join.
NULL_PARTS = 64


def join_on_nullable(df: DataFrame, other: DataFrame, left_key: str, right_key: str, null_match: bool = False, parts: int = NULL_PARTS) -> DataFrame:
    """Many-to-many left join; with ``null_match`` null keys match null keys.

    Null keys are no hot key: a row without one is dealt to one of ``parts`` by a hash of its columns, and with ``null_match`` the
    other side's rows without one are in all of them. Both keys are of one type. A key that many rows have is split by Spark (adaptive skew join).
    """
    own, others = F.col("_key"), F.concat(F.lit("k"), F.col("_key").cast("string"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not f.dataType.simpleString().startswith("map")] or [F.lit(0)]
    part = F.concat(F.lit("n"), F.pmod(F.xxhash64(*hashed), F.lit(parts)).cast("string"))
    left = df.withColumn("_key", _normal(df, left_key)).withColumn("_l", F.when(own.isNull(), part).otherwise(others)).drop("_key")
    right = other.withColumn("_key", _normal(other, right_key))
    if null_match:
        every = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.concat(F.lit("n"), i.cast("string")))
        right = right.withColumn("_r", F.explode(F.when(own.isNull(), every).otherwise(F.array(others))))
    else:
        right = right.where(own.isNotNull()).withColumn("_r", others)
    right = right.drop("_key")
    return left.join(right, left["_l"] == right["_r"], "left").drop("_l", "_r")


def _normal(df: DataFrame, key: str) -> Column:
    """A key such that equal ones are equal as text."""
    return F.col(key) + 0.0 if df.schema[key].dataType.typeName() in ("float", "double") else F.col(key)


def with_totals(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Each row with the total of ``value`` over its group; null is a group."""
    totals = df.groupBy(by).agg(F.sum(value).alias(name)).withColumnRenamed(by, "_by")
    return df.join(totals, df[by].eqNullSafe(totals["_by"]), "left").drop("_by")


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(scalar))


def pending(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return df.join(done, on, "left_anti")


def present_in(df: DataFrame, other: DataFrame, on: str) -> DataFrame:
    return df.join(other, on, "left_semi")
