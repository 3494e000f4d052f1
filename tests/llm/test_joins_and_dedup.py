"""The n-gram join and substring deduplication against brute force, with their edge cases."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lagframe.llm import ngram_join
from lagframe.llm import substring_dedup as dedup
from lagframe.llm import words as W
from lagframe.llm.components import connected_components
from lagframe.llm.ngram_join import ngram_jaccard_join
from lagframe.llm.substring_dedup import factor_spans, substring_dedup

SCHEMA = "doc_id long, text string, token string, rep int, h string, n int"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else (text or ""))


def frame(spark, docs):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in docs], SCHEMA)


def shingles(text, k):
    w = words(text, True)
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def degrees(docs, k, t):
    sets = {i: shingles(text, k) for i, text in docs if i is not None}
    return {i: sum(j != i and bool(x & y) and len(x & y) >= Fraction(t) * len(x | y) for j, y in sets.items()) for i, x in sets.items()}


def components(docs, k, t):
    sets = {i: shingles(text, k) for i, text in docs if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= Fraction(t) * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "t"), [(3, "0.9"), (5, "0.8"), (1, "0.3")])
def test_join(spark, k, t):
    rng = random.Random(k)
    base = [[f"w{rng.randint(0, 50)}" for _ in range(rng.randint(3, 80))] for _ in range(20)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "A b"), (4, "a B"), (5, "é É"), (None, "a b"), (6, "w " * 3000), (7, "w " * 2999)]
    for i in range(10, 160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 20)}"
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, docs), k, t).collect()}
    assert got == components(docs, k, t)
    counted = ngram_jaccard_join(frame(spark, docs), k, t, links=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in counted} == got
    assert {r.doc_id: r.n_links for r in counted} == degrees(docs, k, t)


def test_join_of_repeated_rows_and_nothing(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = ngram_jaccard_join(frame(spark, docs), 3, "0.9").collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1)]
    assert [r.n_links for r in ngram_jaccard_join(frame(spark, docs), 3, "0.9", links=True).collect()] == [2, 2, 2]
    assert ngram_jaccard_join(frame(spark, []), 3, "0.9").count() == 0
    assert ngram_jaccard_join(frame(spark, []), 3, "0.9", links=True).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 60)} == {1}


def removed(docs, window):
    first = {}
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [[word() for _ in range(n)] for n in (window - 1, window, window + 1, 3 * window, 400)]
    docs = [(0, None), (1, ""), (2, "  \n "), (3, "a " * 300), (4, "a " * 70), (5, "b a " * 200)]
    for i in range(10, 90):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [word() for _ in range(rng.randint(0, 40))]
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            w += s[a : rng.randint(a, len(s))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs.append((95, docs[-1][1]))
    docs.append((96, " ".join(f"u{j}" for j in range(5000)) + " " + " ".join(shared[3])))
    out = substring_dedup(frame(spark, [*docs, (None, "x")]), window).collect()
    want = removed(docs, window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == [w[:4] for w in want]
    kept = {w[0]: w[4] for w in want}
    for r in out:
        assert r.kept == (kept[r.doc_id] if r.n_removed else None)
        assert sum(b - a for a, b in r.spans or []) == r.n_removed


def test_substring_dedup_of_repeated_rows_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(80))
    out = substring_dedup(frame(spark, [(7, text), (7, text), (9, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(7, 0), (7, 0), (9, 80)]
    assert substring_dedup(frame(spark, [])).count() == 0


def test_factors_reach_over_boundaries():
    def parsed(doc, refs, window):
        side = lambda texts: W.text_bytes(pa.array([" ".join(t) for t in texts], pa.string()))
        own, (data, offsets) = side([doc]), side(refs)
        starts, ends, ranges = W.word_spans(data, offsets)
        return factor_spans(W.joined(own[0], *W.word_spans(*own)[:2]), W.joined(data, starts, ends), ranges, window)

    doc = [f"{i}" for i in range(30)]
    assert parsed(doc, [doc[:20], doc[12:]], 10) == [(0, 20), (12, 30)]
    assert parsed(doc, [doc[:20], doc[15:]], 10) == [(0, 20), (15, 30)]
    assert parsed(doc, [doc[:9]], 10) == []
    assert parsed(["a"] * 40, [["a"] * 15], 10) == [(0, 15), (6, 21), (12, 27), (18, 33), (24, 39), (30, 40)]


def test_no_pair_is_verified_twice(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        docs.append((i, " ".join(w)))
    seen = []
    verified = ngram_join._verified

    def recorded(pairs, sets, t):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return verified(pairs, sets, t)

    monkeypatch.setattr(ngram_join, "_verified", recorded)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, docs), 3, "0.7").collect()}
    assert got == components(docs, 3, "0.7")
    assert len(seen) == len(set(seen)) > 0


def test_one_id_with_two_texts(spark):
    words = lambda c: [f"{c}{i}" for i in range(60)]
    near = lambda c: " ".join([*words(c)[:-1], "end"])
    a, b = " ".join(words("a")), " ".join(words("b"))
    for first, second in ((a, b), (b, a)):
        rows = [(5, first), (5, second), (5, second), (7, near("a")), (9, near("b")), (5, a.upper()), (3, near("c"))]
        out = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.8").collect()
        assert sorted((r.doc_id, r.component_id, r.class_id) for r in out) == [(3, 3, 3), *[(5, 5, 5)] * 4, (7, 5, 7), (9, 5, 9)]


def test_references_are_cut_to_owned_spans(spark, monkeypatch):
    """A document of windows with as many owners meets ``window`` words for each, however long the owners are."""
    window, rng = 10, np.random.default_rng(5)
    filler = lambda k, n: " ".join(f"f{k}x{v}" for v in rng.integers(0, 1 << 30, n))
    runs = [" ".join(f"r{k}w{i}" for i in range(window)) for k in range(20)]
    docs = [(k, f"{filler(k, 300)} {run} {filler(k, 300)}") for k, run in enumerate(runs)] + [(99, " ".join(runs))]
    met, cut = [], dedup._cut
    monkeypatch.setattr(dedup, "_cut", lambda doc, window: met.append(doc) or cut(doc, window))
    out = {r.doc_id: r for r in substring_dedup(frame(spark, docs), window).collect()}
    assert out[99].n_removed == 20 * window and all(out[k].n_removed == 0 for k in range(20))
    refs = [r for row in met[0].collect() if row.doc_id == 99 for r in row.refs]
    assert sorted(refs) == sorted(runs)
