"""Data-quality rules and their confrontation with a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``test`` is true (pass), false (fail) or null; ``among`` limits the items."""

    name: str
    test: Column
    among: Column | None = None


def not_missing(name: str, column: str, among: Column | None = None) -> Rule:
    return Rule(name, F.col(column).isNotNull(), among)


def in_range(name: str, column: str, low, high) -> Rule:
    """Null for null."""
    return Rule(name, F.col(column).between(low, high))


def in_members(name: str, column: str, members: list) -> Rule:
    """Null fails."""
    return Rule(name, F.coalesce(F.col(column).isin(*members), F.lit(False)))


def matches(name: str, column: str, pattern: str) -> Rule:
    """Null fails."""
    return Rule(name, F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule``, ``items``, ``passes``, ``fails``, ``n_null`` of all rules in one pass."""
    out = []
    for i, r in enumerate(rules):
        here = F.lit(True) if r.among is None else F.coalesce(r.among, F.lit(False))
        out.append(F.struct(F.count_if(here).alias("items"), F.count_if(here & r.test).alias("passes"), F.count_if(here & ~r.test).alias("fails"), F.count_if(here & r.test.isNull()).alias("n_null")).alias(f"_{i}"))
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"_{i}").alias("c")) for i, r in enumerate(rules)])
    return df.agg(*out).select(F.explode(rows).alias("r")).select("r.rule", "r.c.*")


def check_types(df: DataFrame, types: dict[str, set[str]]) -> DataFrame:
    """As :func:`check`, one item for each column: whether it is there with one of the types. Reads the schema only."""
    have = {f.name: f.dataType.typeName() for f in df.schema}
    rows = [(c, 1, int(have.get(c) in kinds), int(have.get(c) not in kinds), 0) for c, kinds in types.items()]
    return df.sparkSession.createDataFrame(rows, "rule string, items long, passes long, fails long, n_null long")


def check_unique(df: DataFrame, columns: list[str], name: str = "unique") -> DataFrame:
    """Uniqueness as a rule: every row of a repeated key fails; null is one key. Counted by key, not by a window over rows."""
    sizes = df.groupBy(*columns).agg(F.count("*").alias("m"))
    return sizes.agg(F.lit(name).alias("rule"), F.coalesce(F.sum("m"), F.lit(0)).alias("items"), F.count_if(F.col("m") == 1).alias("passes"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("fails"), F.lit(0).cast("long").alias("n_null"))
