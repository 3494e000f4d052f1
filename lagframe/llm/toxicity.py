"""Toxicity: a linear-chain CRF tags toxic spans; word marginals add up to document scores and offending offsets."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf, sample
from . import words as W
from .language_id import fold

#: Bounds of the labelled sample that the driver learns from: rows a label, characters a text (of longer ones, pieces).
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 16384
THRESHOLD = 0.7
#: A term marks toxic words only if at least so many sampled texts hold it.
LEAST_TEXTS = 5
#: Texts with labelled words that the chain is fitted to, at most (and twice as many clean ones); ridge on the features' weights.
CHAIN_TEXTS, RIDGE = 400, 0.1
_STEMS, _EDGES = (4, 5, 6, 7, 8), b".,;:!?\"'()"


@dataclass
class Model:
    """The tagger, and the logistic curve over (largest word log-odds, log of the summed marginals)."""

    tagger: crf.Model
    curve: np.ndarray


def _terms(word: bytes) -> set[bytes]:
    return {word + b"$", *(word[:k] for k in _STEMS if len(word) > k)}


def _unlike(texts: list[list[bytes]]) -> list[int]:
    """Indexes of texts that are no near copies of earlier ones: none of four minima over hashes of their 3-word runs was seen."""
    seen: set[int] = set()
    out = []
    seeds = W.mix64(np.arange(1, 5, dtype=np.uint64))
    for i, words in enumerate(texts):
        runs = {b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
        hashes = np.array([zlib.crc32(r) << 32 | zlib.adler32(r) for r in runs], np.uint64)
        own = {int(W.mix64(hashes ^ seed).min()) for seed in seeds}
        if seen.isdisjoint(own):
            out.append(i)
        seen |= own
    return out


def offending_terms(texts: list[str], toxic: list[int]) -> set[bytes]:
    """Words (ending in ``$``) and stems that toxic texts hold and clean ones don't, beyond chance.

    Near copies count once, so that a text copied a thousand times doesn't bring in all its words. A term's texts must all
    be toxic but for one in fifty, and so many that not one of all candidate terms would be expected to get there by chance.
    """
    words = [_lowered(t) for t in texts]
    where: dict[bytes, int] = {}
    clean: dict[bytes, int] = {}
    kept = _unlike(words)
    for i in kept:
        into = where if toxic[i] else clean
        for term in set().union(*(_terms(w.strip(_EDGES)) for w in set(words[i]))) if words[i] else ():
            into[term] = into.get(term, 0) + 1
    bad = sum(toxic[i] for i in kept)
    odds = -np.log(max(bad, 1) / max(len(kept), bad + 1))
    least = max(LEAST_TEXTS, (np.log(max(1, len(where))) + 3) / odds)
    return {t for t, n in where.items() if n >= least and n >= 50 * clean.get(t, 0)}


def _matches(word: bytes, terms: set[bytes]) -> bool:
    return not terms.isdisjoint(_terms(word.strip(_EDGES)))


def tag_words(texts: list[str], toxic: list[int]) -> crf.Model:
    """The tagger: a chain fitted to words that are labelled toxic where a toxic text holds an offending term.

    The terms label the training words only. The chain sees affixes and trigrams, so forms that no training text holds are
    tagged as far as they look like labelled ones.
    """
    none = np.zeros(0, np.uint64)
    terms = offending_terms(texts, toxic)
    tags = [np.array([int(t and _matches(w, terms)) for w in _lowered(text)], int) for text, t in zip(texts, toxic, strict=True)]
    marked = [i for i, tag in enumerate(tags) if tag.any()][:CHAIN_TEXTS]
    clean = [i for i, t in enumerate(toxic) if not t][: 2 * CHAIN_TEXTS]
    own = sorted(marked + clean)
    return crf.train([texts[i] for i in own], [tags[i] for i in own], [0, 1], none, none.astype(int), RIDGE)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on about ``rows`` labelled texts a label (all, of a label with fewer), chosen by a hash of the id among the documents that have a label.

    ``labels`` has ``doc_id`` and ``toxic``; labels without a document, null texts and null ids teach nothing. Texts over
    ``chars`` characters are learned from in pieces of so many in all, near copies once. Words are labelled by :func:`tag_words`. None unless both labels
    occur.
    """
    labels = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    docs = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked, _ = sample.stratified_ids(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic", rows)
    return fit(sample.labelled_texts(docs, picked, "toxic", chars))


def fit(known: list[tuple]) -> Model | None:
    """The model of ``(doc_id, toxic, text)`` rows."""
    if len({t for _, t, _ in known}) < 2:
        return None
    known = [known[i] for i in np.random.default_rng(11).permutation(len(known))]
    kept = _unlike([_lowered(t) for _, _, t in known])
    texts, toxic = [known[i][2] for i in kept], [known[i][1] for i in kept]
    tagger = tag_words(texts, toxic)
    x = [_summary(crf.forward_backward(piece, tagger)[0][:, 1], piece.ranges) for piece in tagger.pieces(pa.array(texts, pa.string()))]
    return Model(tagger, _fit_curve(np.concatenate(x), np.array(toxic, float)))


def _lowered(text: str) -> list[bytes]:
    return W.lower_ascii(np.frombuffer(text.encode(), np.uint8)).tobytes().split() if text else []


def _summary(p: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """A text's features from its words' marginals; a text without words has those of a word surely clean."""
    p = np.clip(p.astype(np.float64), 1e-6, 1 - 1e-6)
    n = len(ranges) - 1
    full = np.flatnonzero(np.diff(ranges) > 0)
    top, total = np.full(n, 1e-6), np.full(n, 1e-6)
    if len(full):
        top[full] = np.maximum.reduceat(p, ranges[full])
        total[full] = np.add.reduceat(np.where(p >= 0.1, p, 0), ranges[full]) + 1e-6
    return np.stack([np.ones(n), np.log(top / (1 - top)) / 4, np.log(total) / 4], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, classes weighted alike, with a small ridge."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
    return w


def score(docs: DataFrame, model: Model | None, spans: bool = False, hashes: bool = False) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (score >= 0.7) of each row; with ``spans`` also ``offending``, an array of
    (first byte, end byte, marginal) for the words whose marginal is at least a half, and with ``hashes`` ``text_hash`` (xxhash64
    of the text), which tells rows of one id or of none apart.

    Texts are scored whole; null is empty, and an empty text scores as if all its words were surely clean. Columns other
    than ``doc_id`` and ``text`` are ignored; repeated rows and null ids are returned as they are. Without a model every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
    fields = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())] + [("offending", kind)] * spans + [("text_hash", pa.int64())] * hashes)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            if m is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array([0.0] * len(ids)), pa.array([0] * len(ids), pa.int32())] + [pa.array([[]] * len(ids), kind)] * spans + ([batch.column("text_hash")] if hashes else []), schema=fields)
                continue
            for piece in m.tagger.pieces(batch.column("text")):
                i, j = piece.rows
                p = crf.forward_backward(piece, m.tagger)[0][:, 1]
                s = 1 / (1 + np.exp(-np.clip(_summary(p, piece.ranges) @ m.curve, -30, 30)))
                columns = [ids.slice(i, j - i), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]
                if spans:
                    out = []
                    offset = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in batch.column("text").slice(i, j - i).to_pylist()])])
                    for d in range(j - i):
                        a, b = piece.ranges[d], piece.ranges[d + 1]
                        out.append([{"start": int(piece.starts[w] - offset[d]), "end": int(piece.ends[w] - offset[d]), "marginal": float(p[w])} for w in a + np.flatnonzero(p[a:b] >= 0.5)])
                    columns.append(pa.array(out, kind))
                if hashes:
                    columns.append(batch.column("text_hash").slice(i, j - i))
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias("text_hash")] * hashes)
    return read.mapInArrow(run, "doc_id long, score double, predicted int" + ", offending array<struct<start long, end long, marginal double>>" * spans + ", text_hash long" * hashes)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels outside fold 1 of 3, score all documents: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = learn(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
