"""Whitening against numpy on whole small tables."""

import numpy as np
import pytest

from lagframe.llm import queries, whitening

from ..compare import DATA


def plain(rows, weights="one", k=4):
    """By id, the contract's columns with one fit list in plain numpy; whitened up to sign."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    counts: dict[tuple, int] = {}
    for _, x in kept:
        counts[tuple(x)] = 1 if weights == "one" else counts.get(tuple(x), 0) + 1
    fit = np.array([x for x, m in counts.items() for _ in range(m)], float)
    n, s = len(fit), [sum(x[d] * m for x, m in counts.items()) for d in range(len(kept[0][1]))]
    v = np.cov(fit.T, bias=True)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    white = lambda x: (np.array(x) - np.array(s) / n) @ axes / np.sqrt(e)
    error = np.abs(np.cov(np.array([white(x) for x in fit]).T, bias=True) - np.eye(k)).max()
    return n, [(i, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), white(x)) for i, x in kept], e / np.trace(v), error


def table(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    return out


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_numpy(spark, weights):
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1] + 1))) for i in range(300)]
    rows += [(1000 + i, [1.5, -2.0, 0.0, -0.0, 1.0, 3.0]) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5), (2004, [1.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows + bad], "vec_id long, embedding array<double>, component string")
    n, want, explained, error = plain(rows, weights)
    got = table(whitening.whiten(df, weights=weights))
    assert sum(len(c[1]) for c in got.values()) == len(rows) and len({(i, d) for i, d, _ in want}) == len(got)
    signs = None
    for i, deviation, white in want:
        own = got[i, deviation]
        assert set(own) == {1, 2, 3, 4}
        mine = np.array([own[c][0].whitened for c in (1, 2, 3, 4)])
        signs = np.sign(mine * white) if signs is None else signs
        assert np.allclose(mine, white * signs, atol=1e-9)
        assert all(r.n == n and r.identity_error <= max(1e-9, error * 10) and abs(r.explained / explained[c - 1] - 1) < 1e-9 for c, rs in own.items() for r in rs)


def test_query_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    n, want, explained, _ = plain(rows)
    got = queries.op11_whitening(spark, DATA).toPandas()
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-4
    assert sorted(set(zip(got.vec_id, got.deviation, strict=True))) == sorted((i, d) for i, d, _ in want)
    assert np.allclose(got.groupby("component").explained.first(), explained)
    white = got.pivot(index="vec_id", columns="component", values="whitened")
    signs = np.sign(white.loc[want[0][0]].to_numpy() * want[0][2])
    assert np.allclose(white.loc[[i for i, _, _ in want]].to_numpy(), np.array([w for _, _, w in want]) * signs, atol=1e-8)


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, []), (2, None)])).count() == 0
    one = whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()  # no variance at all
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in sorted(one)] == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(make([(i, [float(i), 1.0]) for i in range(5)])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component == 2].whitened.isna().all() and flat.identity_error.max() < 1e-9
    with pytest.raises(ValueError):
        whitening.whiten(make([]), weights="all")


def test_large_entries_are_exact(spark):
    rows = [(i, [2.0**40 + i, -(2.0**40) * i]) for i in range(1, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, total = whitening.sums(df.selectExpr("transform(embedding, c -> floor(256 * c)) as x", "1L << 30 as weight"), 2)
    assert n == 3 << 30 and total == [sum(256 * int(v[d]) for _, v in rows) << 30 for d in (0, 1)]
