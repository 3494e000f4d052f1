"""Whitening of embeddings: identical quantised vectors are one, weighted by their number or by one, and whitened once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store

#: A component whose variance is a smaller share of all variance than this has none.
NO_VARIANCE = 1e-12
#: Vectors that are multiplied at a time.
BLOCK = 4096


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches, dim: int):
    """(x, weights) of at most ``BLOCK`` vectors."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield _matrix(part.column("x"), dim), part.column("weight").to_numpy()


def sums(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sum of each dimension, of any size."""

    def run(batches):
        n, total = 0, np.zeros(dim, object)
        for x, w in _blocks(batches, dim):
            n += int(w.sum())
            fits = np.abs(x.astype(float)).max(initial=0) * float(w.max(initial=0)) * len(w) < 2.0**62
            total += (x * w[:, None]).sum(axis=0) if fits else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(int(s)) for s in (n, *total)])], ["at", "s"])

    rows = distinct.mapInArrow(run, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # dim + 1 rows
    by = {r["at"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(k, 0) for k in range(dim)]


def covariance(distinct: DataFrame, dim: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Weighted covariance with divisor ``n``; vectors are centred before they are multiplied, a matrix a task."""
    upper = np.triu_indices(dim)

    def run(batches):
        total = np.zeros((dim, dim))
        for x, w in _blocks(batches, dim):
            d = x - mean
            total += (d * w[:, None]).T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["at", "v"])

    out = np.zeros((dim, dim))
    for at, v in distinct.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():  # dim * (dim + 1) / 2 rows
        i, j = upper[0][at], upper[1][at]
        out[i, j] = out[j, i] = v / n
    return out


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, weights: str = "one") -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row for each row of
    ``vectors(vec_id, embedding)`` and component.

    An entry c becomes ``x = floor(scale * c)`` (at most a long's range). Each distinct x is fitted with weight 1, or with the number
    of its rows (``weights="count"``); ``n`` is the sum of weights. Components are eigenvectors of the covariance by falling eigenvalue, their
    largest entry positive. ``deviation`` is exact modulo 2**64, so exact wherever a long holds it. A component without
    variance has null in ``whitened``, and ``identity_error`` covers the others (null if there is none).

    Vectors that are null or hold null or non-finite entries, and vectors of another length than most (of equally many
    lengths the smallest), are left out. Repeated rows and null ids are returned as they are; other columns are ignored; an empty table
    gives none. The driver and each task hold ``dim * dim`` doubles. A vector that many rows share is counted before the shuffle, and
    met by its rows in a join that Spark may split.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    spark = vectors.sparkSession
    usable = "embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    dim = rows.agg(F.mode(F.size("embedding"), True)).first()[0] or 0
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == dim).select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("x"))
    distinct = store(rows.groupBy("x").agg((F.count("*") if weights == "count" else F.lit(1).cast("long")).alias("weight")))
    n, total = sums(distinct, dim)
    mean = np.array([s / n for s in total])
    v = covariance(distinct, dim, n, mean)
    values, directions = np.linalg.eigh(v)
    k = min(components, dim)
    e, axes = values[::-1][:k], directions[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    varies = e > NO_VARIANCE * trace
    project = axes / np.sqrt(np.where(varies, e, 1.0))
    wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in total], np.int64)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column("x"), dim)
                with np.errstate(over="ignore"):
                    off = x * np.int64(n) - wrapped
                    deviation = (off * off).sum(axis=1)
                w = (x - mean) @ project
                mask = np.broadcast_to(~varies, w.shape).ravel()
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel(), mask=mask))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("weight"), pa.array(deviation), cells], ["x", "weight", "deviation", "w"])

    whitened = store(distinct.mapInArrow(run, "x array<long>, weight long, deviation long, w array<double>"))
    live = [i for i in range(k) if varies[i]]
    error = None
    if live:
        w = [F.col("w")[i] for i in live]
        centre = whitened.agg(*[F.sum(F.col("weight") * c) / n for c in w]).first()
        pairs = [(i, j) for i in range(len(live)) for j in range(i, len(live))]
        got = whitened.agg(*[F.sum(F.col("weight") * (w[i] - centre[i]) * (w[j] - centre[j])) / n for i, j in pairs]).first()
        error = max(abs(g - (i == j)) for g, (i, j) in zip(got, pairs, strict=True))
    explained = F.array(*[F.lit(float(x / trace) if trace > 0 else None).cast("double") for x in e])
    out = rows.join(whitened.select("x", "deviation", "w"), "x").select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("i")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
