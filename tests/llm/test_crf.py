"""Marginals of whole texts against path enumeration and a plain loop over words."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from lagframe.llm import crf
from lagframe.llm import language_id as L
from lagframe.llm import toxicity as T

from ..compare import DATA


def plain(score, start, moves):
    """Marginals, expected first labels and expected moves of one chain, word by word in double precision."""

    def total(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    n, labels = score.shape
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[0] = start + score[0]
    for k in range(1, n):
        alpha[k] = total(alpha[k - 1][:, None] + moves, 0) + score[k]
    for k in range(n - 2, -1, -1):
        beta[k] = total(moves + (score[k + 1] + beta[k + 1])[None], 1)
    z = total(alpha[-1], 0)
    marginal = np.exp(alpha + beta - z)
    expected = sum((np.exp(alpha[k][:, None] + moves + (score[k + 1] + beta[k + 1])[None] - z) for k in range(n - 1)), np.zeros((labels, labels)))
    return marginal, expected


@pytest.mark.parametrize("wide", [32, 2])
def test_chains_of_any_length(monkeypatch, wide):
    """Messages over block borders as matrices, and as vectors."""
    monkeypatch.setattr(crf, "WIDE", wide)
    rng = np.random.default_rng(0)
    model = crf.Model(list("abc"), (rng.normal(size=(1 << crf.TABLE_BITS, 3)) * 0.3).astype(np.float32), rng.normal(size=3), rng.normal(size=(3, 3)) * 2, np.zeros(0, np.uint64), np.zeros(0, int))
    words = lambda n: " ".join(f"w{rng.integers(50)}" for _ in range(n))
    texts = ["a b c d e", "", words(200), None, words(64), words(65), "x", words(1000), words(128)]
    (piece,) = crf.pieces(pa.array(texts, pa.string()), model.lexicon, model.entry)
    got, e = crf.forward_backward(piece, model, lambda z: np.ones(len(z)))
    starts, moves = e.starts, e.moves
    score = crf._scores(piece.slots, piece.first, model.weights).astype(float)[piece.inverse]
    first, all_moves = np.zeros(3), np.zeros((3, 3))
    for a, b in zip(piece.ranges[:-1], piece.ranges[1:], strict=True):
        if a == b:
            continue
        x = score[a:b]
        want, expected = plain(x, model.start, model.transitions)
        assert np.allclose(got[a:b], want, atol=1e-4)
        first, all_moves = first + want[0], all_moves + expected
        if b - a < 8:
            paths = np.zeros_like(x)
            for path in itertools.product(range(3), repeat=b - a):
                weight = np.exp(model.start[path[0]] + x[np.arange(b - a), path].sum() + sum(model.transitions[i, j] for i, j in itertools.pairwise(path)))
                paths[np.arange(b - a), path] += weight
            d = list(piece.ranges).index(a)
            assert np.isclose(np.log(paths[0].sum()), e.log_z[d], atol=1e-5)
            assert np.allclose(paths / paths.sum(axis=1, keepdims=True), want, atol=1e-6)
    assert np.allclose(first, starts, atol=1e-3) and np.allclose(all_moves, moves, rtol=1e-3, atol=1e-2)


def test_a_label_lasts_beyond_a_block():
    """With strong transitions words without evidence bear the label of a word long before."""
    model = crf.Model([0, 1], np.zeros((1 << crf.TABLE_BITS, 2), np.float32), np.zeros(2), np.array([[9.0, -9.0], [-9.0, 9.0]]), np.zeros(0, np.uint64), np.zeros(0, int))
    (piece,) = crf.pieces(pa.array(["start " + "same " * 199]), model.lexicon, model.entry)
    model.weights[crf._slot(piece.hashes[:1], "word")[0]] = [-9, 9]
    assert crf.forward_backward(piece, model)[0][:, 1].min() > 0.99


def test_training_reaches_the_maximum():
    """No change of any weight that is used makes the likelihood, summed over all paths word by word, larger."""
    rng = np.random.default_rng(4)
    texts = [" ".join(str(rng.choice(["ab", "cd", "abc", "x"])) for _ in range(6)) for _ in range(12)]
    tags = [np.array([0 if w.startswith("ab") and rng.random() < 0.8 else 1 for w in t.split()]) for t in texts]
    none = np.zeros(0, np.uint64)
    model = crf.train(texts, tags, [0, 1], none, none.astype(int), ridge=0.5, steps=500, tolerance=1e-6)
    (piece,) = model.pieces(pa.array(texts))

    def loss(w, start, moves):
        score = crf._scores(piece.slots, piece.first, w.astype(float))[piece.inverse].reshape(12, 6, 2)
        out = 0.25 * (w.astype(float) ** 2).sum() + 5e-4 * ((start**2).sum() + (moves**2).sum())
        for x, tag in zip(score, tags, strict=True):
            of = lambda path, x=x: x[np.arange(6), path].sum() + start[path[0]] + sum(moves[i, j] for i, j in itertools.pairwise(path))
            out += np.log(sum(np.exp(of(list(p))) for p in itertools.product(range(2), repeat=6))) - of(list(tag))
        return out

    best = loss(model.weights, model.start, model.transitions)
    for _ in range(40):
        w, start, moves = model.weights.astype(float), model.start.copy(), model.transitions.copy()
        kind = rng.integers(3)
        if kind == 0:
            w[rng.choice(piece.slots), rng.integers(2)] += rng.choice([-0.02, 0.02])
        elif kind == 1:
            start[rng.integers(2)] += rng.choice([-0.02, 0.02])
        else:
            moves[rng.integers(2), rng.integers(2)] += rng.choice([-0.02, 0.02])
        assert loss(w, start, moves) > best - 1e-6


def counts(model, texts, tags):
    real, expected = 0.0, 0.0
    for p in model.pieces(pa.array(texts, pa.string())):
        tag = np.concatenate([tags[d] for d in range(*p.rows)])
        _, e = crf.forward_backward(p, model, lambda z: np.ones(len(z)))
        real, expected = real + crf.real_counts(p, tag, e.weights, len(model.labels))[1], expected + e.moves
    return real, expected


def test_expected_moves_are_the_real_ones(spark):
    """Of languages and of toxic words: at the maximum the model expects as many changes as its training words have."""
    rows = [(r.doc_id, r.lang, r.text[:2000]) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null and text <> ''").collect()]
    labels = sorted({r[1] for r in rows})
    texts, tags = L.switching(sorted(rows), labels)
    model = crf.train(texts, tags, labels, *L.sure_words(texts, tags, len(labels)))
    real, expected = counts(model, texts, tags)
    changes = ~np.eye(len(labels), dtype=bool)
    assert real[changes].sum() > 20 and abs(expected[changes].sum() / real[changes].sum() - 1) < 0.05
    assert abs(np.trace(expected) / np.trace(real) - 1) < 0.001
    rng = np.random.default_rng(0)
    toxic = [int(i % 3 == 0) for i in range(120)]
    pool = [w for _, lang, t in rows if lang == "en" for w in t.split()]
    said = [" ".join(str(rng.choice(pool)) for _ in range(40)) + (" you horrid scoundrel and wretched scoundrel" if t else " you fine people and so on") for t in toxic]
    terms = T.offending_terms(said, toxic)
    tags = [np.array([int(t and T._matches(w, terms)) for w in T._lowered(x)]) for x, t in zip(said, toxic, strict=True)]
    real, expected = counts(T.tag_words(said, toxic), said, tags)
    assert real[0, 1] > 30 and abs(expected[0, 1] / real[0, 1] - 1) < 0.05


def test_switches_are_found_word_by_word(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null and text <> ''").collect()]
    known, new = [r for r in sorted(rows) if r[0] % 4], [r for r in sorted(rows) if r[0] % 4 == 0]
    labels = sorted({r[1] for r in known})
    texts, tags = L.switching([(i, lang, t[:2000]) for i, lang, t in known], labels)
    model = crf.train(texts, tags, labels, *L.sure_words(texts, tags, len(labels)))
    clean = [(lang, t.split()[:60]) for _, lang, t in new if sum(c.isalpha() for c in t) > 0.78 * len(t) and len(t.split()) > 60]
    mixed = [(x, y) for x, y in zip(clean[:-1], clean[1:], strict=True) if x[0] != y[0]]
    right, total, close = 0, 0, 0
    for (a, first), (b, second) in mixed:
        (piece,) = model.pieces(pa.array([" ".join(first + second)]))
        got = crf.forward_backward(piece, model)[0].argmax(axis=1)
        want = np.array([labels.index(a)] * len(first) + [labels.index(b)] * len(second))
        right, total = right + (got == want).sum(), total + len(want)
        changes = np.flatnonzero(np.diff(got)) + 1
        close += len(changes) > 0 and np.abs(changes - len(first)).min() <= 2
    assert len(mixed) >= 5 and right / total > 0.97 and close / len(mixed) > 0.8


def test_many_labels_have_a_bounded_model():
    assert crf.table_bits(4) == crf.TABLE_BITS and (1 << crf.table_bits(1000)) * 1000 <= crf.MOST and crf.table_bits(10**6) == 8
    texts, tags = [f"w{i} w{i} w{i}" for i in range(40)], [np.array([i] * 3) for i in range(40)]
    none = np.zeros(0, np.uint64)
    model = crf.train(texts, tags, list(range(40)), none, none.astype(int), ridge=0.1, steps=60)
    (piece,) = model.pieces(pa.array(texts))
    assert (crf.forward_backward(piece, model)[0].argmax(axis=1) == np.repeat(np.arange(40), 3)).all()
