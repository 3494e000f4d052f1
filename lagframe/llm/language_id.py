"""Language identification: a linear-chain CRF labels the words of (possibly code-switched) text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf, sample

#: Bounds of the labelled sample that the driver learns from: rows a language, characters a text (of longer ones, pieces). Both are
#: less for many languages, see :func:`lagframe.llm.sample.within`.
SAMPLE_ROWS, SAMPLE_CHARS = 250, 4096


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> crf.Model | None:
    """Fit on about ``rows`` labelled texts a language (all, of one with fewer), chosen by a hash of the id; texts over ``chars`` characters are
    learned from in pieces of so many in all, and null ids teach nothing. Every language is learned; for more than ten the sample
    of each is smaller (:func:`~lagframe.llm.sample.within`).

    Every word of a text bears the text's language. A third of the training texts end in words of another text, so that
    the transitions know of switches. The lexicon has the words that one language accounts for at least nine times in ten.
    None without any labelled text.
    """
    docs = docs.where("lang is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows, chars = sample.within(docs.select("lang").distinct().count(), rows, chars)
    picked, _ = sample.stratified_ids(docs, "lang", rows)
    known = sample.labelled_texts(docs, picked, "lang", chars)
    labels = sorted({lang for _, lang, _ in known})
    if not labels:
        return None
    texts, tags = switching(known, labels)
    lexicon, entry = sure_words(texts, tags, len(labels))
    return crf.train(texts, tags, labels, lexicon, entry)


def switching(known: list[tuple], labels: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Training texts and their words' labels, of ``(doc_id, lang, text)`` rows: every third text ends in words of another."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(known))
    texts, tags = [], []
    for k, i in enumerate(order):
        own, label = known[i][2].encode().split(), labels.index(known[i][1])
        tag = np.full(len(own), label)
        if k % 3 == 0 and len(own) > 8:
            other = known[order[rng.integers(len(order))]]
            tail = other[2].encode().split()[: len(own) // 2]
            own[len(own) - len(tail) :] = tail
            tag[len(tag) - len(tail) :] = labels.index(other[1])
        texts.append(b" ".join(own).decode())
        tags.append(tag)
    return texts, tags


def sure_words(texts: list[str], tags: list[np.ndarray], labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that one label accounts for at least nine times in ten, sorted, and that label."""
    counts = np.zeros((0, labels))
    hashes = np.zeros(0, np.uint64)
    for piece in crf.pieces(pa.array(texts, pa.string()), np.zeros(0, np.uint64), np.zeros(0, int), bits=8):
        tag = np.concatenate([tags[d] for d in range(*piece.rows)])
        own = np.zeros((len(piece.distinct), labels))
        np.add.at(own, (piece.inverse, tag), 1)
        merged, back = np.unique(np.concatenate([hashes, piece.hashes[piece.distinct]]), return_inverse=True)
        total = np.zeros((len(merged), labels))
        np.add.at(total, back, np.concatenate([counts, own]))
        hashes, counts = merged, total
    sure = (counts.sum(axis=1) >= 5) & (counts.max(axis=1) >= 0.9 * counts.sum(axis=1))
    return hashes[sure], counts[sure].argmax(axis=1)


def identify(docs: DataFrame, model: crf.Model | None, runs: bool = False) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of each row by the words' marginals; with ``runs`` also ``segments``, an array of
    (language, words) for the runs of equally labelled words.

    The language is the one with the largest mean marginal over the words with letters, ties to the smaller name. A text
    that is null or has no letter is ``und`` with score 0, as is any text if there was nothing to learn from. Texts are
    labelled whole. Columns other than ``doc_id`` and ``text`` are ignored; repeated rows and null ids are returned as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", segments array<struct<lang string, words long>>" * runs
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            if m is None:
                columns = [ids, pa.array(["und"] * len(ids)), pa.array([0.0] * len(ids))] + [pa.array([[]] * len(ids), kind)] * runs
                yield pa.RecordBatch.from_arrays(columns, schema=_names(runs, kind))
                continue
            for piece in m.pieces(text):
                i, j = piece.rows
                marginal, _ = crf.forward_backward(piece, m)
                letter = (piece.data >= 128) | ((piece.data >= 97) & (piece.data <= 122))
                seen = np.concatenate([[0], np.cumsum(letter)])
                has = seen[piece.ends] > seen[piece.starts]
                total = np.zeros((len(has) + 1, len(m.labels)))
                np.cumsum(marginal * has[:, None], axis=0, out=total[1:])
                of = np.concatenate([[0], np.cumsum(has)])
                sums, n = total[piece.ranges[1:]] - total[piece.ranges[:-1]], of[piece.ranges[1:]] - of[piece.ranges[:-1]]
                plain = np.concatenate([[0], np.cumsum((piece.data >= 97) & (piece.data <= 122))])
                at = np.concatenate([piece.starts, [len(piece.data)]])[piece.ranges]
                ascii_letters = plain[at[1:]] - plain[at[:-1]]
                best = sums.argmax(axis=1)
                score = np.clip(sums[np.arange(j - i), best] / np.maximum(n, 1), 0, 1)
                names = [m.labels[b] for b in best]
                for d in np.flatnonzero(ascii_letters == 0):
                    if not n[d] or not any(ch.isalpha() for ch in text[i + int(d)].as_py() or ""):
                        names[d], score[d] = "und", 0.0
                columns = [ids.slice(i, j - i), pa.array(names, pa.string()), pa.array(score, pa.float64())]
                if runs:
                    label, out = marginal.argmax(axis=1), []
                    for d in range(j - i):
                        own = label[piece.ranges[d] : piece.ranges[d + 1]]
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else np.zeros(1, int)
                        out.append([{"lang": m.labels[own[a]], "words": int(b - a)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                    columns.append(pa.array(out, kind))
                yield pa.RecordBatch.from_arrays(columns, schema=_names(runs, kind))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _names(runs: bool, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())] + [("segments", kind)] * runs)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside fold 2 of 4, label all of them: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    model = learn(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
