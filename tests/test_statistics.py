"""Exact quantiles, densities, and the spline regression against plain numpy."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagframe.operators import distribution, splines
from lagframe.operators.quantiles import quantiles, with_ordered_bits
from lagframe.plans.facts import windowed

from .compare import DATA


def test_ordered_bits(spark):
    rng = np.random.default_rng(0)
    v = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 4.0, 4.000000000000001, 3.9999999999999996, 2.0**1000]
    v += [2.0**e for e in range(-1074, 1024, 7)] + list(map(float, np.exp(rng.normal(size=300) * 200) * rng.choice([-1, 1], 300)))
    got = {r.x: r.bits for r in with_ordered_bits(spark.createDataFrame([(x,) for x in v], "x double"), "x").collect()}
    for x, b in got.items():
        own = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
        assert b == (0 if x == 0 else -own if x < 0 else own)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 20000])
def test_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.4, 1.25, np.exp(rng.normal(size=n) * 20) * rng.choice([-1, 1], n))
    g = [None if k == 2 else int(k) for k in rng.integers(0, 3, n)]
    rows = [*zip(g, x.tolist(), strict=True), (0, None), (7, None)]
    shares = (0.25, 0.5, 0.75, 0.0, 1.0, 0.3)
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g long, v double"), "g", "v", shares).collect()}
    assert set(got) == set(g)
    for k in got:
        own = x[[h == k for h in g]]
        assert got[k].rows == len(own) and np.allclose(got[k].q, np.quantile(own, shares), rtol=1e-12, atol=0)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([(1, None)], "g long, v double"), "g", "v", (0.5,)).count() == 0


def test_density_is_the_kernel_sum(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=3000), "b": np.exp(rng.normal(size=500)), "one": np.ones(1), "flat": np.ones(9)}
    rows = [(g, float(v), 1.0) for g, vs in groups.items() for v in vs] + [(None, 1.0, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, y double, x double")
    got = distribution.density(df, F.col("y"), F.col("k"), points=40).toPandas()
    assert set(got.grp) == {"a", "b"} and len(got) == 80
    ends = [v for vs in groups.values() for v in vs]
    grid = np.linspace(min(ends), max(ends), 40)
    for g in ("a", "b"):
        v = groups[g]
        q1, q3 = np.quantile(v, [0.25, 0.75])
        h = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
        want = np.exp(-(((grid[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        own = got[got.grp == g].sort_values("x")
        assert np.allclose(own.x, grid) and np.abs(own.density - want).max() < 1e-10 * want.max()


@pytest.mark.parametrize("cyclic", [False, True])
def test_spline_basis(cyclic):
    knots = np.array([0.0, 1.0, 2.5, 4.0, 5.0, 7.0])
    s = splines.Smooth(knots, cyclic)
    m = len(s.second)
    assert np.allclose(s.rows(knots[:m]), np.eye(m))
    rng = np.random.default_rng(0)
    beta = rng.normal(size=m)
    f = lambda x: s.rows(np.atleast_1d(x)) @ beta
    d, inner = 1e-4, knots[1:-1]
    for k in inner:  # value, slope and curvature go on over a knot
        curve = lambda x: (f(x + d) - 2 * f(x) + f(x - d)) / d**2
        assert np.allclose(f(k - 1e-9), f(k + 1e-9), atol=1e-6)
        assert np.allclose((f(k) - f(k - d)) / d, (f(k + d) - f(k)) / d, atol=1e-2)
        assert np.allclose(curve(k - 2 * d), curve(k + 2 * d), atol=2e-2)
    if cyclic:
        assert np.allclose(f(knots[0]), f(knots[-1])) and np.allclose((f(knots[0] + d) - f(knots[0])) / d, (f(knots[-1]) - f(knots[-1] - d)) / d, atol=1e-2)
    x = (np.arange(20000) + 0.5) / 20000 * 7
    bend = (f(np.minimum(x + 1e-3, 7)) - 2 * f(x) + f(np.maximum(x - 1e-3, 0))) / 1e-6
    assert abs((bend[10:-10] ** 2).sum() * 7 / 20000 / (beta @ s.penalty @ beta) - 1) < 0.01


def test_fit_of_cells_is_the_fit_of_rows(spark):
    """Penalised least squares over single rows, reweighted, with the same penalties."""
    df = windowed(spark, DATA)
    f = splines.fit_cells(splines._collected(df, "acceptance_delay", "article_date"), ridge={"month": 3.0, "year": 20.0, "weekday": 0.5})
    rows = df.where("acceptance_delay > 0 and article_date is not null").selectExpr("month(article_date) m", "year(article_date) y", "dayofweek(article_date) w", "double(acceptance_delay) v").toPandas()
    x, penalty, spans, at = [np.ones((len(rows), 1))], {}, {}, 1
    for t, c, lam in (("month", "m", 3.0), ("year", "y", 20.0), ("weekday", "w", 0.5)):
        x.append(f.smooths[t].rows(rows[c].to_numpy(float)) @ f.bases[t])
        assert np.allclose(x[-1].sum(axis=0), 0, atol=1e-6)
        penalty[t] = lam * f.bases[t].T @ f.smooths[t].penalty @ f.bases[t]
        spans[t] = slice(at, at := at + x[-1].shape[1])
    x, v = np.concatenate(x, axis=1), rows.v.to_numpy()
    root = np.zeros((at, at))
    for t, s in spans.items():
        e, q = np.linalg.eigh(penalty[t])
        root[s, s] = (q * np.sqrt(np.maximum(e, 0))).T
    eta = np.full(len(v), math.log(v.mean()))
    for _ in range(30):
        mu = np.exp(eta)
        beta = np.linalg.lstsq(np.concatenate([x, root]), np.concatenate([eta + (v - mu) / mu, np.zeros(at)]), rcond=None)[0]
        eta = x @ beta
    mu = np.exp(eta)
    assert np.allclose([f.intercept, *np.concatenate([f.coefficients[t] for t in spans])], beta, atol=1e-7)
    assert np.isclose(f.deviance, 2 * (-np.log(v / mu) + (v - mu) / mu).sum()) and np.isclose(f.null_deviance, 2 * (-np.log(v / v.mean())).sum())
    hat = np.linalg.solve(x.T @ x + root.T @ root, x.T @ x)
    assert all(np.isclose(f.edf[t], np.trace(hat[s, s]), atol=1e-6) for t, s in spans.items())
    assert np.isclose(f.scale, (((v - mu) / mu) ** 2).sum() / (len(v) - np.trace(hat)))


def test_smooths_find_a_season(spark):
    rng = np.random.default_rng(5)
    days = [np.datetime64("2016-01-01") + int(d) for d in rng.integers(0, 3000, 20000)]
    month = np.array([d.astype("datetime64[M]").astype(int) % 12 + 1 for d in days])
    y = rng.gamma(2.0, np.exp(4 + 0.5 * np.sin(2 * np.pi * (month - 1) / 11)) / 2)
    df = spark.createDataFrame([(str(d), float(v)) for d, v in zip(days, y, strict=True)], "d string, v double").withColumn("d", F.to_date("d"))
    got = {(r.term, r.statistic): r.value for r in splines.seasonal_summary(df, "v", "d").collect()}
    assert got["model", "n"] == 20000 and 0.05 < got["model", "deviance_explained"] < 0.4 and got["month", "edf"] > 3 and 0.4 < got["model", "scale"] < 0.6
    effect = {r["at"]: r.effect for r in splines.seasonal_effects(df, "v", "d").where("term = 'month'").collect()}
    assert effect[4] > 0.35 and effect[9] < -0.35 and abs(effect[1] - effect[12]) < 1e-9
    assert splines.seasonal_summary(df.limit(0), "v", "d").count() == 0
