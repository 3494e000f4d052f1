"""Token ids against the tokenizer, packing and the length histogram against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lagframe.llm import packing, token_counts
from lagframe.llm import tokens as K

ODD = ["", "it's we'll they're ''s 's 't 'sup I'm you'd x'll  'ree", "a  b\n\n c\t\td \n", "  ", " \n", "x  y", "日本語 text", "naïve 12ab３４ ½²", "<|endoftext|> hi", "\x1c\x1d a\x85b", "don't 'S", "tab\t'ab 'a", "é x̀", "'", "a's", " 's", "'s's're", "w " * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    return K.tokenizer(K.default_path())


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(list("ab '\n\t 1.é's ltdmrve日")) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    got = []
    for i, j, ids, at in K.encoded(pa.array([*texts, None]), K.default_path()):
        got += [ids[at[d] : at[d + 1]].tolist() for d in range(j - i)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer

    stock = Tokenizer.from_file(K.default_path())
    end = "<|endoftext|>"
    texts = ["plain", f"{end} hi", "", "a <|endof", "text|> b", f"x{end}{end} y'll", "é", f"日本{end}", "<|endoftext |>", end, "last"]
    got = []
    for i, j, ids, at in K.encoded(pa.array(texts), K.default_path()):
        got += [ids[at[d] : at[d + 1]].tolist() for d in range(j - i)]
    assert got == [stock.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[9] == [stock.token_to_id(end)]


def test_patterns_hold_the_demand():
    rng = np.random.default_rng(0)
    size, demand = np.array([1, 3, 5, 9, 20, 31]), rng.integers(1, 300, 6)
    plan = packing.patterns(size, demand, 32)
    assert all((p * size).sum() <= 32 for p, _ in plan)
    assert (sum(p * n for p, n in plan) >= demand).all()
    assert sum(n for _, n in plan) <= (size * demand).sum() / 32 * 1.05 + 4


def test_packing(spark, tokenizer):
    rng = random.Random(5)
    texts = [None, *ODD, *[" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([3, 90, 400, 1500]))) for _ in range(120)]]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "null id", 5), (7, texts[7], 5)]
    out = packing.packing(spark.createDataFrame(rows, "doc_id long, text string, length int")).toPandas()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    seen = {}
    for r in out.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        own = ids[key][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[key])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        seen[key] = seen.get(key, 0) + r.length
    assert seen == {k: len(v) * (2 if k == 7 else 1) for k, v in ids.items()}
    total = 0
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
        total += 1
    assert total <= out.length.sum() / 2048 * 1.02 + 1
    assert packing.packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_histogram_answers_all_limits(spark, tokenizer):
    rng = random.Random(8)
    texts = [None, "", *["a b " * rng.randint(0, 3000) for _ in range(60)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n_tokens long, text string")
    n = np.array([len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts])
    limits = token_counts.context_limits(token_counts.length_histogram(docs)).cache()
    for r in limits.collect():
        assert r.n_docs == (n == r.n_tokens).sum() and r.docs_at_least == (n >= r.n_tokens).sum()
        assert r.tokens_at_least == n[n >= r.n_tokens].sum() and r.truncated_total == np.minimum(n, r.n_tokens).sum()
        assert r.total_docs == len(n) and r.total_tokens == n.sum() and abs(r["quantile"] - (n <= r.n_tokens).mean()) < 1e-12
    for r in token_counts.at_limits(limits, [0, 1, 7, 2048, 4096, 10**6]).collect():
        assert r.truncated_total == np.minimum(n, r.context).sum() and r.docs_longer == (n > r.context).sum()
    assert token_counts.context_limits(token_counts.length_histogram(docs.limit(0))).count() == 0
