"""Quality rules against a plain count; the SQL twin covers whole tables."""

import math
import re
from collections import Counter

import numpy as np

from lagframe.llm import quality as Q

from ..compare import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(runs)
    covered = {i + o for i, r in enumerate(runs) if n[r] > 1 for o in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    rng = np.random.default_rng(5)
    pool = ["a", "b", "çé", "#x|", "<b>", "the,", " word", "z" * 40, "𝒳y"]
    gaps = [" ", "\n", "\r\n", "\t", "  ", "\n\n", "\x0b"]
    texts = [None, "", " \n\t ", "one", "\n", "x\nx\nx", "x \nx\nx\n", "a b c d e f g h " * 5, "\n" * 50 + "x" * 70_000]
    texts += ["".join(rng.choice(pool) + rng.choice(gaps) for _ in range(int(rng.integers(1, 200)))) for _ in range(150)]
    df = spark.createDataFrame([(i % 140, t, None if i % 3 else "xx", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = Q.quality(df).toPandas()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(tuple, got[["doc_id", *columns]].to_numpy().tolist())) == sorted((i % 140, *base(t)) for i, t in enumerate(texts))
    assert (got.base_failed == ((got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words))).all()
    assert not (got.kept & got.base_failed).any()


def js(p, q):
    total = sum(p.values())
    out = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0) / total, q.get(k, 0.0)
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0, out / 2))


def test_distances(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    lower = lambda t: re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")
    words = {}
    for r in rows:
        words.setdefault(r.lang, Counter()).update(WORD.findall(lower(r.text)))
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    judged = 0
    for r in rows:
        total = sum(words[r.lang].values())
        common = {w: n / total for w, n in words[r.lang].items() if 200 * n >= total}
        own = Counter(w if w in common else None for w in WORD.findall(lower(r.text)))
        want = js(own, common | {None: 1 - sum(common.values())}) if sum(own.values()) >= 50 and total >= 1000 else None
        d = got[r.doc_id].word_distance
        assert (d is None) == (want is None) and (d is None or abs(d - want) < 1e-9)
        judged += want is not None
    assert judged > 50


def test_junk_goes_and_clean_text_stays(spark):
    rng = np.random.default_rng(1)
    common, rare = ["the", "of", "and", "to", "in"], [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    clean = lambda n: " ".join(str(rng.choice(common if rng.random() < 0.4 else rare)) for _ in range(n)) + "."
    rows = [(i, clean(120), "en") for i in range(60)]
    rows += [(100, clean(100).upper(), "en"), (101, " ".join(w + "###" for w in clean(100).split()), "en"), (102, " | ".join(rng.permutation(rare)[:120]), "en")]
    rows += [(200, clean(30), "en"), (201, clean(120), None), (202, clean(120), "zz"), (203, clean(100).upper(), None), (204, "too short", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in Q.quality(df).where("kept").collect()}
    assert kept == {*range(60), 200, 201, 202}
    assert Q.quality(df.limit(0)).count() == 0
    alone = Q.quality(df.where("doc_id = 100")).collect()  # no reference: nothing is judged
    assert [(r.kept, r.char_distance, r.word_distance) for r in alone] == [(True, None, None)]
