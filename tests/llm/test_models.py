"""Language, toxicity and mixing: held-out accuracy, edge cases, and a brute-force fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagframe.llm import language_id, mixing, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_language(spark, docs):
    out = language_id.language_id(docs).join(docs, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and 150 < len(held) < 350
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_language_edges_and_code_switching(spark, docs):
    model = language_id.learn(docs.where("doc_id < 400"))
    own = {r.lang: r.text for r in docs.where("doc_id >= 400").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    mixed = " ".join(own["de"].split()[:40] + own["es"].split()[:60])
    rows = [(1, None, "z"), (2, "", "z"), (3, "12 34 !!", "z"), (4, own["fr"], "z"), (4, own["fr"], "z"), (None, own["en"], "z"), (6, mixed, "z"), (7, own["de"] * 20, "z")]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model, runs=True).collect()
    got = [(r.doc_id, r.lang_pred) for r in out]
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr"), (None, "en")] and got[7] == (7, "de")
    spans = {s.lang: s.words for s in out[6].segments}
    assert spans["de"] > 30 and spans["es"] > 50
    none = language_id.learn(docs.limit(0))
    assert none is None
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_toxicity(spark, docs, labels):
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert out.score.between(0, 1).all()
    assert ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert held.predicted[held.toxic == 0].mean() < 0.03
    marked = held.predicted == 1
    assert marked[held.toxic == 1].mean() >= 0.5 and held.toxic[marked].mean() >= 0.7


def test_labels_without_documents_take_no_place(spark):
    texts = [(i, f"{'gubbish' if i % 2 else 'flowers'} here and number {i} ends so w{i} x{i * 7}.") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.range(1000, 200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").union(spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    model = toxicity.learn(docs, marks, rows=60)
    out = toxicity.score(docs, model).toPandas()
    assert (out.predicted == out.doc_id % 2).all()
    rare = marks.selectExpr("doc_id", "if(doc_id = 7, 'rare', if(toxic = 1, 'a', 'b')) as domain")
    post = mixing.posteriors(docs, rare, ["a", "b", "rare"]).toPandas().set_index("doc_id")
    assert post.p2.idxmax() == 7  # one document of a domain among 199,200 labels is learned from
    assert (post.p0 > post.p1)[post.index % 2 == 1].drop(7).all() and (post.p1 > post.p0)[post.index % 2 == 0].all()


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "en", f"the quiet river number {i} runs along the old mill") for i in range(40)]
    rows += [(100 + i, "xx", f"zug kvar {i} mluk strev " * 5000) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.learn(docs, rows=20)
    assert model.labels == ["en", "xx"]
    out = language_id.identify(docs, model).toPandas()
    assert (out.lang_pred == ["en"] * 40 + ["xx"] * 6).all()


def test_toxic_spans_and_edges(spark, docs, labels):
    texts = [(i, f"Calm words here {'gubbish' if i % 2 else 'flowers'} and number {i} ends so w{i} x{i * 7} y{i * 13}.", "c") for i in range(200)]
    own = spark.createDataFrame(texts, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.learn(own, marks)
    rows = [(1, "a é gubbish, day", "c"), (2, "a calm day", "c"), (3, None, "c"), (4, "", "c"), (None, "gubbish", "c"), (1, "a é gubbish, day", "c"), (5, "calm " * 50000 + "gubbish", "c")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model, spans=True).collect()
    assert [r.predicted for r in out] == [1, 0, 0, 0, 1, 1, 1]
    s = out[0].offending[0]
    assert rows[0][1].encode()[s.start : s.end] == b"gubbish,"
    assert toxicity.learn(own, marks.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(own.limit(2), None).collect()} == {0.0}
    assert toxicity.score(own.limit(0), model).count() == 0


def test_posteriors_are_those_of_naive_bayes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{rng.integers(0, 12) + 6 * (i % 2)}" for _ in range(rng.integers(1, 9)))) for i in range(60)]
    marks = [(i, "ab"[i % 2]) for i in range(40)]
    got = mixing.posteriors(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, domain string"), ["a", "b"]).toPandas().set_index("doc_id")
    sets = {i: set(t.split()) for i, t in rows}
    for i, own in sets.items():
        logit = []
        for k in (0, 1):
            inside = [sets[j] for j in range(40) if j % 2 == k]
            value = np.log(21 / 42)
            for w in own:
                n = [sum(w in sets[j] for j in range(40) if j % 2 == c) for c in (0, 1)]
                if sum(n):
                    share, overall = (n[k] + 0.5) / (len(inside) + 1), (sum(n) + 0.5) / 41
                    value += np.clip(np.log(share / overall), -3, 3)
            logit.append(value)
        assert abs(got.p0[i] - 1 / (1 + np.exp(logit[1] - logit[0]))) < 1e-9


def fit(n, p, goal, rounds):
    r = np.ones(len(n))
    for _ in range(rounds):
        s = (r * n) @ p - goal
        live = n * (r > 0)
        r = np.maximum(0, r - p @ (np.linalg.pinv((p * live[:, None]).T @ p) @ s))
    return r


def test_mixing_meets_targets_as_brute_force_does(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 500, 300)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double").coalesce(1)
    goal = np.array([0.7, 0.25, 0.05]) * n.sum()
    got = np.array([r.rate for r in mixing.fit_rates(table, list(goal)).collect()])
    assert (got >= 0).all() and np.abs((got * n) @ p - goal).max() < 1e-4 * goal.sum()
    assert np.allclose(got, fit(n, p, goal, 40), atol=0.02)


def test_mixing(spark, docs, labels):
    weights = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    out = mixing.mix(docs, mixing.label_domains(labels), weights).toPandas()
    assert len(out) == 1000 and (out.rate >= 0).all() and (out.copies >= 0).all()
    total = (np.stack(out.posterior) * (out.rate * out.n_tokens).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(total / out.n_tokens.sum(), [0.8, 0.15, 0.05], atol=1e-3)
    assert ((out.copies == np.floor(out.rate)) | (out.copies == np.floor(out.rate) + 1)).all()


def test_mixing_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (None, "x", "a"), (4, " lead and trail ", "a"), (5, "w " * 30000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    out = mixing.mix(docs, none, {"a": 1.0, "b": 1.0}).toPandas()
    assert sorted(out.n_tokens) == [0, 0, 1, 3, 3, 3, 30000]
    one = spark.createDataFrame([(3, "a"), (3, "a"), (4, "b"), (None, "a"), (9, "zzz")], "doc_id long, domain string")
    assert len(mixing.mix(docs, one, {"a": 1.0, "b": 3.0}).toPandas()) == 7
    assert mixing.mix(docs.limit(0), one, {"a": 1.0, "b": 1.0}).count() == 0
    assert mixing.mix(docs, one, {"a": 1.0}).count() == 7
