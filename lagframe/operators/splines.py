"""Smooth regression of delays: penalised cubic splines, cyclic for month and weekday, fitted from one aggregation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Smooth:
    """A cubic spline through its values at knots: ``rows(x)`` are its basis at x, ``penalty`` its integrated squared second derivative.

    A cyclic one has the same value and derivatives at its first and last knot, whose parameters are one.
    """

    knots: np.ndarray
    cyclic: bool

    def __post_init__(self) -> None:
        h, m = np.diff(self.knots), len(self.knots) - self.cyclic
        inner = range(m) if self.cyclic else range(1, m - 1)
        b, d = np.zeros((m, m)), np.zeros((m, m))
        for j in inner:  # continuity of the first derivative at knot j
            left, right = h[j - 1], h[j]
            a, c = (j - 1) % m, (j + 1) % m
            b[j, a] += left / 6
            b[j, j] += (left + right) / 3
            b[j, c] += right / 6
            d[j, a] += 1 / left
            d[j, j] -= 1 / left + 1 / right
            d[j, c] += 1 / right
        keep = list(inner)
        self.second = np.zeros((m, m))  # second derivatives at the knots from the values there
        self.second[keep] = np.linalg.solve(b[np.ix_(keep, keep)], d[keep])
        self.penalty = d[keep].T @ self.second[keep]

    def rows(self, x: np.ndarray) -> np.ndarray:
        m = len(self.second)
        j = np.clip(np.searchsorted(self.knots, x, "right") - 1, 0, len(self.knots) - 2)
        h, left, right = np.diff(self.knots)[j], x - self.knots[j], self.knots[j + 1] - x
        out = np.zeros((len(x), m))
        at = np.arange(len(x))
        a, c = j % m, (j + 1) % m
        np.add.at(out, (at, a), right / h)
        np.add.at(out, (at, c), left / h)
        out += ((right**3 / h - h * right) / 6)[:, None] * self.second[a] + ((left**3 / h - h * left) / 6)[:, None] * self.second[c]
        return out


def knots(values: np.ndarray, k: int) -> np.ndarray:
    """``k`` knots spread evenly over the distinct values (all of them where there are fewer)."""
    own = np.unique(values)
    return np.quantile(own, np.linspace(0, 1, min(k, len(own))))


def cells(df: DataFrame, value: str, date: str) -> DataFrame:
    """``month``, ``year``, ``weekday``, ``n``, ``total``, ``logs``, ``squares``: all that a fit with these terms needs of the rows with a positive
    value and a date. A Gamma likelihood depends on a cell's rows by their number, sum and sum of logarithms only (and its
    dispersion by the sum of squares), and there are 84 cells a year."""
    y = F.col(value).cast("double")
    own = df.where((y > 0) & F.col(date).isNotNull()).select(F.month(date).alias("month"), F.year(date).alias("year"), F.dayofweek(date).alias("weekday"), y.alias("y"))
    return own.groupBy("month", "year", "weekday").agg(F.count("*").alias("n"), F.sum("y").alias("total"), F.sum(F.log("y")).alias("logs"), F.sum(F.col("y") * F.col("y")).alias("squares"))


TERMS = {"month": (12, True), "year": (8, False), "weekday": (7, True)}


@dataclass
class Fit:
    """Coefficients by column of the design, the terms' columns, effective degrees of freedom, and sums of the fit."""

    intercept: float
    smooths: dict[str, Smooth]
    bases: dict[str, np.ndarray]
    coefficients: dict[str, np.ndarray]
    edf: dict[str, float]
    n: float
    deviance: float
    null_deviance: float
    scale: float

    def effect(self, term: str, x: np.ndarray) -> np.ndarray:
        return self.smooths[term].rows(np.asarray(x, float)) @ self.bases[term] @ self.coefficients[term]


def fit_cells(table: dict[str, np.ndarray], terms: dict[str, tuple[int, bool]] = TERMS, ridge: dict[str, float] | None = None, rounds: int = 60) -> Fit:
    """Gamma regression with log link on smooths of the terms, by penalised reweighted least squares.

    Each smooth sums to zero over the rows. Weights of the penalties (``ridge``) are those given, or those with the least
    generalised cross-validation score, searched by term over powers of ten. All sums are over cells; matrices have a row for each coefficient.
    """
    n, y = table["n"].astype(float), table["total"] / table["n"]
    smooths = {t: Smooth(knots(table[t].astype(float), k), cyclic) for t, (k, cyclic) in terms.items() if len(np.unique(table[t])) > 2}
    x, bases, spans, penalties = [np.ones((len(n), 1))], {}, {}, {}
    at = 1
    for t, s in smooths.items():
        raw = s.rows(table[t].astype(float))
        q = np.linalg.qr((n @ raw)[:, None], mode="complete")[0][:, 1:]  # what sums to zero
        bases[t], penalties[t] = q, q.T @ s.penalty @ q
        x.append(raw @ q)
        spans[t] = slice(at, at + q.shape[1])
        at += q.shape[1]
    design = np.concatenate(x, axis=1)
    gram = (design * n[:, None]).T @ design  # the working weights of a log-link Gamma fit are the rows' numbers
    deviance = lambda mu: 2 * float((-table["logs"] + n * np.log(mu) + table["total"] / mu - n).sum())

    def fit(weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray, float]:
        penalty = np.zeros_like(gram)
        for t, span in spans.items():
            penalty[span, span] = weights[t] * penalties[t]
        inverse = np.linalg.pinv(gram + penalty, rcond=1e-13, hermitian=True)
        eta = np.full(len(n), math.log(table["total"].sum() / n.sum()))
        beta = np.zeros(at)
        for _ in range(rounds):
            mu = np.exp(eta)
            new = inverse @ (design.T @ (n * (eta + (y - mu) / mu)))
            eta, done, beta = design @ new, np.abs(new - beta).max() < 1e-10, new
            if done:
                break
        return beta, inverse @ gram, deviance(np.exp(eta))

    total = n.sum()
    score = lambda w: (lambda b, h, d: total * d / (total - np.trace(h)) ** 2)(*fit(w))
    if ridge is None:
        ridge = dict.fromkeys(spans, 1.0)
        for _ in range(2):
            for t in spans:
                ridge[t] = min((10.0**p for p in range(-4, 9)), key=lambda v, t=t: score(ridge | {t: v}))
    beta, hat, own = fit(ridge)
    mu = np.exp(design @ beta)
    pearson = float(((table["squares"] - 2 * mu * table["total"] + n * mu**2) / mu**2).sum())
    edf = {t: float(np.trace(hat[s, s])) for t, s in spans.items()}
    return Fit(float(beta[0]), smooths, bases, {t: beta[s] for t, s in spans.items()}, edf, float(total), own, deviance(np.full(len(n), table["total"].sum() / total)), float(pearson / (total - np.trace(hat))))


def _collected(df: DataFrame, value: str, date: str) -> dict[str, np.ndarray]:
    rows = cells(df, value, date).orderBy("year", "month", "weekday").collect()  # 84 rows a year
    return {c: np.array([r[c] for r in rows], float) for c in ("month", "year", "weekday", "n", "total", "logs", "squares")}


def seasonal_fit(df: DataFrame, value: str, date: str) -> Fit | None:
    table = _collected(df, value, date)
    return fit_cells(table) if len(table["n"]) else None


def seasonal_summary(df: DataFrame, value: str, date: str) -> DataFrame:
    """``term``, ``statistic``, ``value``: intercept, each smooth's effective degrees of freedom, the explained share of the deviance, the
    scale (Pearson's) and the number of rows. No rows without a positive value with a date."""
    f = seasonal_fit(df, value, date)
    out = []
    if f:
        out = [("intercept", "estimate", f.intercept), *[(t, "edf", e) for t, e in f.edf.items()]]
        out += [("model", "deviance_explained", 1 - f.deviance / f.null_deviance if f.null_deviance > 0 else 0.0), ("model", "scale", f.scale), ("model", "n", f.n)]
    return df.sparkSession.createDataFrame(out, "term string, statistic string, value double")


def seasonal_effects(df: DataFrame, value: str, date: str) -> DataFrame:
    """``term``, ``at``, ``effect``: the fitted smooths (on the log scale) at each month, year and weekday that occurs."""
    table = _collected(df, value, date)
    out = []
    if len(table["n"]):
        f = fit_cells(table)
        for t in f.smooths:
            at = np.unique(table[t])
            out += [(t, int(a), float(e)) for a, e in zip(at, f.effect(t, at), strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, at int, effect double")
