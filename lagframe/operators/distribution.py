"""The data behind distribution figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagframe.sources.shared import stored

from .joins import with_scalar
from .quantiles import quantiles, with_ordered_bits


def ranked_counts(df: DataFrame, by: str) -> DataFrame:
    """Rows by category and the category's rank by falling count (ties share a rank).

    Ranks come from the distinct counts: of N rows there are fewer than the root of 2 N, so their window stays small.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    before = F.sum("m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.groupBy("n").agg(F.count("*").alias("m")).select("n", (F.coalesce(before, F.lit(0)) + 1).cast("int").alias("rank"))
    return counts.join(ranks, "n").select(by, "n", "rank")


def date_histogram(df: DataFrame, date: str, bins: int = 30) -> DataFrame:
    """``bin`` (from 1), ``n`` for equal widths between the first and the last day; the last day is in the last bin."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    days = df.select(day.alias("d")).where("d is not null").groupBy("d").agg(F.count("*").alias("n"))
    ends = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    at = F.least(F.lit(bins), F.floor((F.col("d") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))) + 1)
    return with_scalar(days, ends).groupBy(at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


#: Cells of a bandwidth, moments kept of each, and how many bandwidths the kernel reaches: the rest is below 1e-11 of its peak.
CELLS, MOMENTS, REACH = 2, 14, 8


def density(df: DataFrame, value: Column, group: Column, points: int = 512, low: float | None = None, high: float | None = None) -> DataFrame:
    """Gaussian kernel density by group on a grid of equally spaced points: ``grp``, ``x``, ``density``.

    The bandwidth is 0.9 * min(sd, IQR / 1.34) * N ** -0.2 of the group. The grid is [low, high], or the range of all values.
    Groups with one value or no spread have no rows.

    Rows are summed up in cells of half a bandwidth, by their moments about the cell's middle, from which the kernel sum at
    a point is a series of Hermite polynomials: the density differs from the sum over all rows by less than 1e-10 of its peak. So rows
    don't meet the grid; cells do, and a group has no more of them than its range has half bandwidths.
    """
    rows = df.select(group.alias("grp"), value.cast("double").alias("v")).where("v is not null and grp is not null")
    if low is not None:
        rows = rows.where(F.col("v").between(low, high))
    rows = stored(with_ordered_bits(rows, "v"))
    stats = rows.groupBy("grp").agg(F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))
    stats = stats.join(quantiles(rows, "grp", "v", (0.25, 0.75)), "grp")
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    stats = stats.withColumn("h", 0.9 * spread * F.pow("rows", F.lit(-0.2)))
    ends = stats.agg(F.min("least").alias("lo"), F.max("most").alias("hi")) if low is None else df.sparkSession.range(1).select(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select((F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"))
    sizes = stats.where("h > 0").select(F.col("grp").alias("g"), F.col("rows").alias("n"), "h")
    scaled = rows.join(sizes, F.col("grp") == F.col("g")).withColumn("cell", F.floor(F.col("v") / F.col("h") * CELLS))
    t = F.col("v") / F.col("h") - (F.col("cell") + 0.5) / CELLS
    powers = [F.sum(F.pow(t, F.lit(float(p)))).alias(f"m{p}") for p in range(MOMENTS)]
    cells = scaled.groupBy("grp", "n", "h", "cell").agg(*powers)
    z = F.col("x") / F.col("h") - (F.col("cell") + 0.5) / CELLS
    near = F.abs(F.col("x") / F.col("h") - (F.col("cell") + 0.5) / CELLS) <= REACH
    met = cells.join(F.broadcast(grid), near).withColumn("z", z)  # the grid has ``points`` rows
    before, now = F.lit(0.0), F.lit(1.0)
    series = F.col("m0")
    for p in range(1, MOMENTS):  # He_p = z He_(p-1) - (p - 1) He_(p-2), summed by nested products
        before, now = now, F.col(f"he{p - 1}") * F.col("z") - (p - 1) * before if p > 1 else F.col("z")
        met = met.withColumn(f"he{p}", now)
        before, now = F.col(f"he{p - 1}") if p > 1 else F.lit(1.0), F.col(f"he{p}")
        series = series + F.col(f"he{p}") * F.col(f"m{p}") / math.factorial(p)
    kernel = F.sum(F.exp(-F.col("z") * F.col("z") / 2) * series) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))
    found = met.groupBy("grp", "x").agg(kernel.alias("density"))
    everywhere = sizes.select(F.col("g").alias("grp")).join(F.broadcast(grid))
    return everywhere.join(found, ["grp", "x"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def group_centres(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and median of each group in long form, with the quartiles of all rows as reference lines."""
    centres = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))
    lines = df.agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    return with_scalar(centres.unpivot(by, ["mean", "median"], "statistic", "value"), lines)


def level_counts_by_year(wide: DataFrame, ids: list[str], prefix: str) -> DataFrame:
    """Rows by year and level from year-indexed columns."""
    long = wide.unpivot(ids, [c for c in wide.columns if c.startswith(prefix)], "year", "level")
    return long.where("level is not null").groupBy(F.regexp_replace("year", f"^{prefix}", "").cast("int").alias("year"), "level").agg(F.count("*").alias("n"))


def year_curves(monthly: DataFrame, years: list[int]) -> DataFrame:
    """A column for each year from ``year, month, mean_delay`` rows."""
    return monthly.groupBy("month").pivot("year", years).agg(F.first("mean_delay"))
