"""Exact quantiles of any column without ranking its values: radix selection over the ordered bits of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Low bits that are left out of the histograms: a round counts the values of the bins that hold a wanted rank, by 20 or 22 further bits.
ROUNDS = (44, 22, 0)


def with_ordered_bits(df: DataFrame, x: str, name: str = "bits") -> DataFrame:
    """Add a long that orders doubles as they are: the 64 bits of the value, mirrored for negative ones. NaN comes last, -0.0 is 0.0.

    The exponent comes from a logarithm, which may be off by one near a power of two and is then set right; scaling by powers
    of two is exact. Each step is a column of its own, so that it is computed once.
    """
    size, e, m = F.col("_size"), F.col("_e"), F.col("_m")
    df = df.withColumn("_size", F.abs(x)).withColumn("_e", F.floor(F.log2(size)).cast("double"))
    df = df.withColumn("_m", size * F.pow(F.lit(2.0), -e))
    off = F.when(m >= 2, 1.0).when(m < 1, -1.0).otherwise(0.0)
    part = F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m) - 1
    normal = (e + off + 1023).cast("long") * F.lit(1 << 52) + (part * F.lit(2.0**52)).cast("long")
    tiny = (size * F.lit(2.0**1022) * F.lit(2.0**52)).cast("long")
    df = df.withColumn("_b", F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, tiny).otherwise(normal))
    return df.withColumn(name, F.when(F.col(x) < 0, -F.col("_b")).otherwise(F.col("_b"))).drop("_size", "_e", "_m", "_b")


def quantiles(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """``by``, ``rows``, ``q`` (an array, one value a share) for each group with values: linear interpolation between ranks.

    Three rounds, each an aggregation to a histogram by a slice of the values' bits and a running sum over its bins, of which
    a group has 2**20 or 2**22 at most. After each only the bins that hold a wanted rank are counted again. A null value doesn't
    count; a null group is one. A column ``bits`` is taken as :func:`with_ordered_bits` of the value. ``by`` should have few values: the driver sees a row for each and rank a round.
    """
    spark = df.sparkSession
    own = [F.col(by).alias("g"), F.col(value).cast("double").alias("x")]
    keyed = df.select(*own, "bits").where("x is not null") if "bits" in df.columns else with_ordered_bits(df.select(*own).where("x is not null"), "x")
    kind = keyed.schema["g"].dataType.simpleString()
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in (_place(s) for s in shares)])))
    held, on, found = keyed, ["g"], []
    for shift in ROUNDS:
        bins = held.groupBy(*on, F.shiftright("bits", shift).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("x"))
        running = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)) + (F.col("base") if found else 0))
        if not found:
            bins = bins.withColumn("rows", F.sum("n").over(Window.partitionBy("g"))).withColumn("ranks", ranks)
        own = F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        found = bins.withColumn("ranks", own).where(F.size("ranks") > 0).select("g", "bin", "before", "rows", "ranks", "x").collect()  # two ranks a share
        if not shift or not found:
            break
        marks = spark.createDataFrame([tuple(r)[:5] for r in found], f"mg {kind}, of long, base long, rows long, ranks array<long>")
        held = keyed.join(F.broadcast(marks), [F.col("g").eqNullSafe(F.col("mg")), F.shiftright("bits", shift) == F.col("of")]).drop("mg")
        on = ["g", "of", "base", "rows", "ranks"]
    each = spark.createDataFrame([(r["g"], r["rows"], k, r["x"]) for r in found for k in r["ranks"]], f"g {kind}, rows long, rank long, x double")
    at = each.groupBy("g", "rows").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    out = []
    for p in map(_place, shares):
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        out.append(F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    return at.select(F.col("g").alias(by), "rows", F.array(*out).alias("q"))


def _place(share: float) -> Column:
    """Where a share's quantile lies among the ranks from 0."""
    return (F.col("rows") - 1) * F.lit(float(share))
