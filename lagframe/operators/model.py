"""Seasonal regression of delays, fitted on the cluster."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seasonal_features(df: DataFrame, date: str, knots: list[float], harmonics: int = 2) -> tuple[DataFrame, list[str]]:
    """Cyclic terms of month and weekday, and hinges of the year: the basis of the regression."""
    out, names = df, []
    for name, value, period in (("month", F.month(date), 12), ("weekday", F.dayofweek(date), 7)):
        for k in range(1, harmonics + 1):
            for f in (F.sin, F.cos):
                column = f"{name}_{f.__name__}{k}"
                out, names = out.withColumn(column, f(value * (2 * math.pi * k / period))), [*names, column]
    year = F.year(date) + (F.dayofyear(date) - 1) / 366
    for i, knot in enumerate(knots):
        out, names = out.withColumn(f"year_{i}", F.greatest(year - knot, F.lit(0.0))), [*names, f"year_{i}"]
    return out, names


def fit_seasonal(df: DataFrame, value: str, date: str, knots: list[float]) -> tuple[PipelineModel, list[str]]:
    """Gamma regression with log link of a positive value on the seasonal basis; rows with nulls or no positive value are left out."""
    own, names = seasonal_features(df.where(F.col(value) > 0).where(F.col(date).isNotNull()), date, knots)
    own = own.withColumn(value, F.col(value).cast("double"))
    glm = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="features", labelCol=value, maxIter=50, regParam=1e-6)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), glm]).fit(own), names


def seasonal_coefficients(df: DataFrame, value: str, date: str, knots: list[float]) -> DataFrame:
    """``term``, ``coefficient``: the intercept and a row for each basis term."""
    model, names = fit_seasonal(df, value, date, knots)
    glm = model.stages[-1]
    rows = [("intercept", float(glm.intercept)), *zip(names, map(float, glm.coefficients), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")
