"""Descriptive tables: counts, shares, delays, quantiles, profiles. Every one is an aggregation; nothing is collected.

Delays are whole days of at most a few years, so exact percentiles hold a bounded number of distinct values a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagframe.functions.dates import floor_month
from lagframe.sources.shared import stored

from .joins import with_scalar
from .quantiles import quantiles, with_ordered_bits

DELAYS = ["acceptance_delay", "publication_delay"]
#: Day limits of the threshold shares.
LIMITS = [60, 180, 365]
QUARTILES = (0.25, 0.5, 0.75)


def _percent(part: Column, whole: Column) -> Column:
    return part / whole * 100


def yearly_share(df: DataFrame, year: Column) -> DataFrame:
    """``article_year``, ``article_number``, ``all_articles``, ``percentage``; null years are left out."""
    counts = df.groupBy(year.alias("article_year")).agg(F.count("*").alias("article_number"))
    out = with_scalar(counts, counts.agg(F.sum("article_number").alias("all_articles"))).where("article_year is not null")
    return out.withColumn("percentage", _percent(F.col("article_number"), F.col("all_articles")))


def monthly_delays(df: DataFrame, date: str = "article_date") -> DataFrame:
    return df.groupBy(floor_month(F.col(date)).alias("month")).agg(F.count("*").alias("n"), F.avg(DELAYS[0]).alias("mean_acc_delay"), F.avg(DELAYS[1]).alias("mean_pub_delay"))


def flag_share(df: DataFrame, flag: Column, year: Column, strict_null: bool = False) -> DataFrame:
    """By year: all rows, flagged rows, and the flagged rows' share of all flagged rows, of all rows, and of the year's rows.

    A null flag isn't counted; with ``strict_null`` it makes its year's and the total's counts null.
    """
    rows = df.select(year.alias("article_year"), flag.alias("_flag"))
    count = F.count_if("_flag")
    if strict_null:
        count = F.when(F.count_if(F.col("_flag").isNull()) == 0, count)
    out = rows.groupBy("article_year").agg(F.count("*").alias("all_this_year"), count.alias("flagged"))
    whole = F.sum("flagged") if not strict_null else F.when(F.count_if(F.col("flagged").isNull()) == 0, F.sum("flagged"))
    totals = out.agg(F.sum("all_this_year").alias("all_articles"), whole.alias("all_flagged"))
    out = with_scalar(out, totals).where("article_year is not null")
    return out.withColumns({"percentage_flagged": _percent(F.col("flagged"), F.nullif(F.col("all_flagged"), F.lit(0))), "percentage_all": _percent(F.col("flagged"), F.col("all_articles")), "percentage_this_year": _percent(F.col("flagged"), F.col("all_this_year"))})


def category_share(df: DataFrame, category: str) -> DataFrame:
    """Rows by category, null being one, and their share of all rows."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    out = with_scalar(counts, counts.agg(F.sum("n").alias("all_articles")))
    return out.withColumn("percentage_all", _percent(F.col("n"), F.col("all_articles")))


def level_share(df: DataFrame, year: Column, level: str) -> DataFrame:
    """Rows by year and level: share of the year, and share of the year's rows that have a level (null for the null level)."""
    counts = df.groupBy(year.alias("article_year"), level).agg(F.count("*").alias("n"))
    per_year = Window.partitionBy("article_year")
    out = counts.withColumn("all_this_year", F.sum("n").over(per_year)).withColumn("_known", F.sum(F.when(F.col(level).isNotNull(), F.col("n"))).over(per_year))
    return out.withColumns({"percentage_year": _percent(F.col("n"), F.col("all_this_year")), "percentage_known": F.when(F.col(level).isNotNull(), _percent(F.col("n"), F.col("_known")))}).drop("_known")


def overall_delays(df: DataFrame) -> DataFrame:
    """``variable``, ``value``: n, and for both delays mean, sd, median, quartiles, extremes, range between quartiles and shares."""
    stats: dict[str, Column] = {"n": F.count("*").cast("double")}
    for c, name in zip(DELAYS, ("acceptance", "publication"), strict=True):
        stats |= {f"{name}_mean": F.avg(c), f"{name}_sd": F.stddev_samp(c), f"{name}_median": F.median(c), f"{name}_q25": F.percentile(c, 0.25), f"{name}_q75": F.percentile(c, 0.75), f"{name}_min": F.min(c).cast("double"), f"{name}_max": F.max(c).cast("double"), f"{name}_iqr": F.percentile(c, 0.75) - F.percentile(c, 0.25)}
        stats |= {f"{name}_le_{d}": F.count_if(F.col(c) <= d) / F.count("*") for d in (60, 90, 180, 365)}
    one = df.agg(*[v.alias(k) for k, v in stats.items()])
    return one.unpivot([], list(stats), "variable", "value")


def _delay_columns(thresholds: bool) -> list[Column]:
    out = [F.count("*").alias("n")]
    for c, name in zip(DELAYS, ("acc", "pub"), strict=True):
        out += [F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}")]
        if thresholds:
            out += [(F.count_if(F.col(c) <= d) / F.count("*")).alias(f"{name}_le_{d}") for d in LIMITS]
    return out


def delays_by(df: DataFrame, *by: str, thresholds: bool = True) -> DataFrame:
    """n, means, medians and threshold shares of both delays by named columns; groups with a null are left out."""
    return df.dropna(subset=list(by)).groupBy(*by).agg(*_delay_columns(thresholds))


def yearly_delays(df: DataFrame, year: Column) -> DataFrame:
    return delays_by(df.withColumn("article_year", year), "article_year", thresholds=False)


def delays_by_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """``variable``, ``level`` and the delay columns for several groupings in one pass over the data."""
    each = df.select(*DELAYS, *[F.col(c).cast("string").alias(c) for c in columns])
    sets = each.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("_set"), *_delay_columns(True))
    codes = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    variable = F.lit(None).cast("string")
    for c, code in codes.items():
        variable = F.when(F.col("_set") == code, c).otherwise(variable)
    return sets.withColumn("variable", variable).withColumn("level", F.coalesce(*columns)).where("level is not null").drop("_set", *columns)


def logical_profile(df: DataFrame, flags: list[str]) -> DataFrame:
    """``variable``, ``is_false``, ``is_true``, ``is_na`` for boolean columns."""
    one = df.agg(*[F.struct(F.count_if(~F.col(c)).alias("is_false"), F.count_if(c).alias("is_true"), F.count_if(F.col(c).isNull()).alias("is_na")).alias(c) for c in flags])
    return one.unpivot([], flags, "variable", "p").select("variable", "p.*")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """``variable``, min, q1, mean, median, sd, q3, max, iqr for numeric columns; nulls are ignored, and a column without values
    has no row. Quartiles are exact for any number of distinct values, see :func:`~lagframe.operators.quantiles.quantiles`."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "x").where("x is not null")
    long = stored(with_ordered_bits(long, "x"))
    whole = long.groupBy("variable").agg(F.min("x").alias("min"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.max("x").alias("max"))
    out = whole.join(quantiles(long, "variable", "x", QUARTILES), "variable")
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    return out.select("variable", "min", q1.alias("q1"), "mean", median.alias("median"), "sd", q3.alias("q3"), "max", (q3 - q1).alias("iqr"))


def latest_vs_pooled(wide: DataFrame, key: str, prefix: str, latest: str, digits: int = 3) -> DataFrame:
    """Per key the latest year's value and the mean over all cells of the year columns, rounded."""
    cells = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.select(key, *[F.col(c).cast("double").alias(c) for c in cells]).unpivot(key, cells, "year", "x")
    pooled = long.groupBy(key).agg(F.bround(F.avg("x"), digits).alias("pooled_mean"))
    return wide.select(key, F.col(latest).cast("double").alias("latest")).distinct().join(pooled, key)


def subset_delays(df: DataFrame, keep: Column) -> DataFrame:
    """n, mean, median, sd of both delays in a subset: one row."""
    out = [F.count("*").alias("n")]
    for c, name in zip(DELAYS, ("acc", "pub"), strict=True):
        out += [F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}"), F.stddev_samp(c).alias(f"sd_{name}")]
    return df.where(keep).agg(*out)


def subset_frequency(df: DataFrame, keep: Column, by: Column, name: str) -> DataFrame:
    """Rows of a subset by group, and their share of the subset."""
    counts = df.where(keep).withColumn(name, by).groupBy(name).agg(F.count("*").alias("n"))
    out = with_scalar(counts, counts.agg(F.sum("n").alias("total")))
    return out.select(name, "n", (F.col("n") / F.col("total")).alias("share"))


def monthly_deciles(df: DataFrame, date: str, value: str) -> DataFrame:
    """``month``, ``decile`` (0.1 to 0.9), ``value``."""
    at = [i / 10 for i in range(1, 10)]
    q = df.groupBy(floor_month(F.col(date)).alias("month")).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("q"))
    return q.select("month", F.posexplode("q").alias("i", "value")).select("month", ((F.col("i") + 1) / 10).alias("decile"), "value")


def outliers(df: DataFrame, low: int = 1, high: int = 1095) -> DataFrame:
    """Rows at or below the low limit, at or above the high limit, and either, for both delays: one row."""
    out = []
    for c in DELAYS:
        x = F.col(c)
        out += [F.count_if(x <= low).alias(f"{c}_low"), F.count_if(x >= high).alias(f"{c}_high"), F.count_if((x <= low) | (x >= high)).alias(f"{c}_either")]
    return df.agg(*out)


def distinct_groups(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).agg(F.countDistinct(by).alias("n"))


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))


def small_group_share(df: DataFrame, by: str, below: int = 10) -> DataFrame:
    """Groups of fewer than ``below`` rows and their share of all groups: one row."""
    return group_sizes(df, by).agg(F.count_if(F.col("n") < below).alias("small"), F.count("*").alias("groups"), F.bround(F.count_if(F.col("n") < below) / F.count("*") * 100, 2).alias("percentage"))


def counts_by(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows by a label; rows without one are left out."""
    return df.select(by.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def flag_since(df: DataFrame, flag: Column, date: str, since: str) -> DataFrame:
    """Flagged rows since a day, and their share of the whole table: one row."""
    hit = F.count_if(flag & (F.col(date) >= F.lit(since).cast("date")))
    return df.agg(hit.alias("flagged"), F.count("*").alias("total"), F.bround(hit / F.count("*") * 100, 3).alias("percentage"))


def delay_by_year_and_month(df: DataFrame, date: str = "article_date", value: str = "acceptance_delay") -> DataFrame:
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.avg(value).alias("mean_delay"), F.count("*").alias("n"))


def agreement_rate(df: DataFrame, agrees: Column, counted: Column) -> DataFrame:
    """Agreeing rows among the counted ones, over all rows of the table: one row."""
    return df.agg(F.sum(F.when(counted, agrees).otherwise(0)).alias("agreement"), F.count("*").alias("total"), (F.sum(F.when(counted, agrees).otherwise(0)) / F.count("*") * 100).alias("percentage"))


def attrition(df: DataFrame, file: str, stages: dict[str, Column]) -> DataFrame:
    """Rows of each file that pass the first condition, the first two, and so on, with all rows as ``raw``."""
    passed, out = F.lit(True), [F.count("*").alias("raw")]
    for name, condition in stages.items():
        passed = passed & condition
        out.append(F.count_if(passed).alias(name))
    return df.groupBy(file).agg(*out)


def attrition_total(per_file: DataFrame, file: str) -> DataFrame:
    """The sums of :func:`attrition`'s counts over all files: one row."""
    return per_file.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_file.columns if c != file])
