"""Hand-made rows for null logic, formats, order and rounding."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagframe.functions import dates, flags, text
from lagframe.operators import dedupe, distribution, filters, joins, model, reshape, rules, summary

D = dt.date


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_partial_dates(spark):
    got = column(spark, ["2020", "2020-03", "2020-03-04", "junk", None], "string", dates.parse_partial_date)
    assert got == [D(2020, 1, 1), D(2020, 3, 1), D(2020, 3, 4), None, None]


def test_us_timestamps(spark):
    assert column(spark, ["3/14/2020 0:00", "13/1/2020 0:00", None], "string", dates.parse_us_timestamp) == [D(2020, 3, 14), None, None]


def test_labels(spark):
    assert column(spark, [D(2016, 10, 5), D(2016, 1, 5), None], "date", dates.month_label) == ["2016-10-01", "2016-1-01", None]
    assert column(spark, [D(2016, 1, 1), None], "date", lambda c: dates.year_label(c, keep_null=True)) == ["2016", "NA"]


def test_keyword_flag(spark):
    df = spark.createDataFrame([("COVID-19 x", None), ("covids", "y"), ("SARS-CoV-2.", "z"), ("none", None), (None, "wuhan virus")], "t string, k string")
    assert [r[0] for r in df.select(text.keyword_flag(F.col("t"), F.col("k"), text.PANDEMIC_TERMS)).collect()] == [True, False, True, None, True]


def test_types_and_sentinels(spark):
    assert column(spark, ["D016428:Journal Article; D013485:Research Support", None], "string", text.extract_types) == ["Journal Article, Research Support", None]
    assert column(spark, ["-", "NA", "_", "", "a", None], "string", text.null_sentinels) == [None, None, None, None, "a", None]


def test_buckets(spark):
    got = column(spark, ["1000", "1100", "2700", "3616", "3700", None, "x"], "string", flags.discipline)
    assert got == ["multidisciplinary", "life_sciences", "health_sciences", "health_sciences", None, None, None]
    assert column(spark, [3200, 3207, 3208, None], "int", lambda c: flags.in_interval(c, *flags.PSYCHOLOGY_CODES)) == [True, True, False, None]
    assert column(spark, ["24701343", "1", None], "string", lambda c: flags.in_set(c, flags.MEGA_JOURNALS)) == [True, False, False]


def test_seasonal_regression_is_that_of_reweighted_least_squares(spark):
    df = spark.range(3000).selectExpr("cast(pmod(xxhash64(id), 200) + 1 as int) as delay", "date_add(date'2016-01-01', cast(pmod(xxhash64(id, 3), 2000) as int)) as day")
    got = {r.term: r.coefficient for r in model.seasonal_coefficients(df, "delay", "day", [2016.0, 2019.0]).collect()}
    own, names = model.seasonal_features(df, "day", [2016.0, 2019.0])
    x = own.select("delay", *names).toPandas()
    y, a = x["delay"].to_numpy(float), np.column_stack([np.ones(len(x)), x[names].to_numpy()])
    w = np.linalg.lstsq(a, np.log(y), rcond=None)[0]
    for _ in range(50):  # gamma with log link: all weights are one
        mu = np.exp(a @ w)
        w = np.linalg.lstsq(a, a @ w + (y - mu) / mu, rcond=None)[0]
    assert np.allclose([got["intercept"], *(got[n] for n in names)], w, atol=1e-3)


def test_half_even(spark):
    assert column(spark, [2.5, 3.5], "double", flags.half_even) == [2.0, 4.0]


def test_date_order(spark):
    rows = [(D(2020, 1, 1), D(2020, 1, 1), D(2020, 2, 1)), (D(2020, 1, 1), D(2020, 2, 1), D(2020, 2, 1)), (D(2020, 1, 1), D(2020, 1, 5), None), (D(2020, 1, 1), D(2020, 1, 5), D(2020, 2, 1))]
    assert filters.date_order(spark.createDataFrame(rows, "received date, accepted date, article_date date")).count() == 1


def test_issn_keys(spark):
    df = spark.createDataFrame([(1, "1234-5678", None), (2, None, None), (3, "1111-1111", "2222-222X"), (4, "NA", "")], "i int, p string, o string")
    assert sorted((r.i, r.issn_linking) for r in reshape.issn_keys(df, "p", "o").collect()) == [(1, "12345678"), (3, "11111111"), (3, "2222222X")]


def test_canonical_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a B` int, c int")
    out = reshape.canonical_columns(df)
    assert out.columns == ["a_b", "c"] and tuple(out.first()) == (1, 3)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_keep_first(spark, parts):
    rows = [("t", "b", 1, 10), ("t", "a", 2, 20), (None, "a", 1, 30), (None, "b", 3, 40), ("u", "b", 2, 50)]
    df = spark.createDataFrame(rows, "title string, file string, ordinal int, v int").repartition(parts)
    assert sorted(r.v for r in dedupe.keep_first(df, ["title"], ["file", "ordinal"]).collect()) == [20, 30, 50]


def test_year_lookup(spark):
    dim = spark.createDataFrame([("k", 2015, "Q1"), ("k", 2024, "Q2")], "key string, year int, q string")
    df = spark.createDataFrame([("k", y) for y in (2014, 2015, 2024, 2025, None)], "key string, y int")
    assert {r.y: r.q for r in joins.year_lookup(df, dim, "key", F.col("y"), 2024, ["q"]).collect()} == {2014: None, 2015: "Q1", 2024: "Q2", 2025: "Q2", None: None}
    assert {r.y: r.q for r in joins.year_lookup(df, dim, "key", F.col("y"), 2024, ["q"], clamp=False).collect()}[2025] is None


def test_retraction_fan_out(spark):
    a = spark.createDataFrame([("d1", 1), (None, 2)], "doi string, n int")
    r = spark.createDataFrame([("d1", "x"), ("d1", "y"), (None, "z")], "merge_key string, reason string")
    assert joins.join_on_nullable(a, r, "doi", "merge_key").where("reason is not null").count() == 2
    assert joins.join_on_nullable(a, r, "doi", "merge_key", null_match=True).where("reason is not null").count() == 3


def test_flag_share_nulls(spark):
    df = spark.createDataFrame([("2020", True), ("2020", None), ("2021", True)], "y string, f boolean")
    assert {r.article_year: r.flagged for r in summary.flag_share(df, F.col("f"), F.col("y")).collect()} == {"2020": 1, "2021": 1}
    assert {r.article_year: r.flagged for r in summary.flag_share(df, F.col("f"), F.col("y"), strict_null=True).collect()} == {"2020": None, "2021": 1}


def test_quantiles(spark):
    df = spark.createDataFrame([(x, x) for x in (1, 2, 3, 4)], "acceptance_delay int, publication_delay int")
    got = {r.variable: r.value for r in summary.overall_delays(df).collect()}
    assert (got["acceptance_q25"], got["acceptance_median"], got["acceptance_q75"]) == (1.75, 2.5, 3.25)
    assert got["acceptance_iqr"] == got["acceptance_q75"] - got["acceptance_q25"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (9, "b")], "x int, s string")
    got = {r.rule: (r["items"], r.passes, r.fails, r.n_null) for r in rules.check(df, [rules.in_range("r", "x", 0, 5), rules.in_members("s", "s", ["a"])]).collect()}
    assert got == {"r": (3, 1, 1, 1), "s": (3, 1, 2, 0)}
    assert [r.passes for r in rules.check_types(df, {"x": {"integer"}, "s": {"date"}, "z": {"string"}}).collect()] == [True, False, False]
    assert tuple(rules.check_unique(df.union(df), ["x"]).first())[1:4] == (6, 0, 6)


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i % 17), "a") for i in range(400)], "v double, g string")
    got = distribution.density(df, F.col("v"), F.col("g"), points=256, low=-10, high=30).orderBy("x").collect()
    step = got[1].x - got[0].x
    assert abs(sum(r.density for r in got) * step - 1) < 0.01


def test_empty_tables(spark):
    df = spark.createDataFrame([], "article_date date, acceptance_delay int, publication_delay int, received date, accepted date, title string")
    assert summary.monthly_delays(filters.analysis_window(filters.date_order(df))).count() == 0
    assert dedupe.keep_first(df, ["title"], ["received"]).count() == 0
    assert distribution.date_histogram(df, "article_date").count() == 0


def test_quartiles_of_heavy_tails_ties_and_few_values(spark):
    columns = [F.exp(F.randn(3) * 4).alias("heavy"), (F.rand(4) * 10).cast("int").alias("tied"), F.lit(5.0).alias("one"), F.when(F.col("id") < 4, F.col("id")).alias("few"), F.lit(None).cast("double").alias("none")]
    df = spark.range(30000).select(columns).cache()
    got = {r.variable: [r.q1, r.median, r.q3] for r in summary.numeric_profile(df, df.columns).collect()}
    values = df.toPandas()
    df.unpersist()
    assert sorted(got) == ["few", "heavy", "one", "tied"]
    for name, quartiles in got.items():
        assert np.allclose(quartiles, np.quantile(values[name].dropna().astype(float), [0.25, 0.5, 0.75]), rtol=1e-12, atol=0)
