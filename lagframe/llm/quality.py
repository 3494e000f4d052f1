"""Quality rules: counts of each text, and its character-class and common-word histograms against its language's references.

The references are the histograms of all documents of a language. Distances are Jensen-Shannon distances (base 2, so 0 to 1);
a histogram of too short a text says nothing and isn't judged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import store

#: Base rules: fewer words than this fail, and more than so many hundredths of the words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: A word is common if it is at least one in so many of its language's words, so a language has no more common words than that.
COMMON = 200
#: A language needs so many words to have a reference.
REFERENCE_WORDS = 1000
#: Texts with fewer characters or words aren't judged by that histogram; largest distances of a kept text.
LEAST_CHARS, LEAST_JUDGED = 200, 50
CHAR_DISTANCE, WORD_DISTANCE = 0.3, 0.45

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "blank", "punctuation", "symbol", "other")
_INSIDE = len(CLASSES)  # further bytes of a character


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"))
    out[128:] = CLASSES.index("other")
    out[128:192] = _INSIDE
    out[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    out[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    out[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    out[[32, *range(9, 14)]] = CLASSES.index("blank")
    out[list(PUNCTUATION)] = CLASSES.index("punctuation")
    return out


_CLASS = _class_table()


@dataclass
class References:
    """By language: shares of the character classes, and of its common words (by hash, sorted) with all others last."""

    chars: dict[str, np.ndarray]
    words: dict[str, tuple[np.ndarray, np.ndarray]]


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets)) * (_INSIDE + 1)
    return np.bincount(of + _CLASS[data], minlength=n * (_INSIDE + 1)).reshape(n, _INSIDE + 1)[:, :_INSIDE]


def references(docs: DataFrame, common: int = COMMON, least: int = REFERENCE_WORDS) -> References:
    """Histograms of all texts of each language. Null texts and languages, and languages of fewer than ``least`` words, add nothing.

    Words are counted a piece of a partition at a time and then by Spark; the driver gets the common words only, at most
    ``common`` of a language.
    """

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
                classes = _class_counts(data, offsets)
                lower = W.lower_ascii(data)
                starts, ends, ranges = W.word_spans(lower, offsets)
                hashes = W.span_hashes(lower, starts, ends)
                rows: list[tuple[str, int, bytes, int]] = []
                raw, own = lower.tobytes(), langs[i:j]
                for lang in set(own):
                    mine = own == lang
                    rows += [(lang, 0, c.encode(), int(n)) for c, n in zip(CLASSES, classes[mine].sum(axis=0), strict=True)]
                    at = np.flatnonzero(np.repeat(mine, np.diff(ranges)))
                    _, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
                    rows.append((lang, 1, b"", len(at)))
                    rows += [(lang, 2, raw[starts[w] : ends[w]], int(k)) for w, k in zip(at[first], n, strict=True)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], ["lang", "kind", "item", "n"])

    pieces = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(run, "lang string, kind int, item binary, n long")
    counts = store(pieces.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    totals = counts.where("kind = 1").select("lang", F.col("n").alias("total")).where(F.col("total") >= least)
    held = counts.where("kind <> 1").join(F.broadcast(totals), "lang").where((F.col("kind") == 0) | (F.col("n") * common >= F.col("total")))  # a row a language
    chars: dict[str, np.ndarray] = {}
    words: dict[str, list] = {}
    for lang, kind, item, n, total in held.select("lang", "kind", "item", "n", "total").collect():
        if kind == 0:
            chars.setdefault(lang, np.zeros(len(CLASSES)))[CLASSES.index(item.decode())] = n
        else:
            words.setdefault(lang, []).append((bytes(item), n / total))
    return References({k: v / v.sum() for k, v in chars.items()}, {k: _word_reference(words.get(k, [])) for k in chars})


def _word_reference(common: list[tuple[bytes, float]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(w for w, _ in common), np.uint8)
    ends = np.cumsum([len(w) + 1 for w, _ in common]).astype(np.int64) - 1
    starts = ends - np.array([len(w) for w, _ in common], np.int64)
    hashes = W.span_hashes(data, starts, ends) if common else np.zeros(0, np.uint64)
    order, share = np.argsort(hashes), np.array([s for _, s in common])
    return hashes[order], np.append(share[order], max(0.0, 1 - share.sum()))


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's histogram from the reference's; 0 for an empty row."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    plog = lambda a, b: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(b > 0, b, 1)), 0.0)
    out = (plog(p, m) + plog(np.broadcast_to(reference, p.shape), m)).sum(axis=1) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(out, 0, 1)), 0.0)


def _distances(refs: References, langs: np.ndarray, classes: np.ndarray, hashes: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances by character classes and by common words, NaN where not judged; without a language of its own that has a
    reference, a text has those of the reference that it is nearest to, as a share of the limits."""
    n_words, n = np.diff(ranges), len(langs)
    out = np.full((2, n), np.nan)
    judged = (classes.sum(axis=1) >= LEAST_CHARS, n_words >= LEAST_JUDGED)
    unknown = np.array([x not in refs.chars for x in langs], bool)
    worst = np.full(n, np.inf)
    for lang, chars in refs.chars.items():
        mine = ((langs == lang) | unknown) & (judged[0] | judged[1])
        if not mine.any():
            continue
        found = np.full((2, n), np.nan)
        a = np.flatnonzero(mine & judged[0])
        found[0, a] = distance(classes[a], chars)
        b = np.flatnonzero(mine & judged[1])
        known, shares = refs.words[lang]
        place = np.full(n, -1)
        place[b] = np.arange(len(b))
        of = np.repeat(place, n_words)
        inside = of >= 0
        at = np.searchsorted(known, hashes[inside])
        hit = (at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == hashes[inside]) if len(known) else np.zeros(len(at), bool)
        bins = np.where(hit, at, len(known))
        counts = np.bincount(of[inside] * len(shares) + bins, minlength=len(b) * len(shares)).reshape(len(b), len(shares))
        found[1, b] = distance(counts, shares)
        badness = np.fmax(found[0] / CHAR_DISTANCE, found[1] / WORD_DISTANCE)
        better = mine & (badness < worst)
        out[:, better] = found[:, better]
        worst[better] = badness[better]
    return out[0], out[1]


def _repeats(texts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once in its text."""
    order = np.lexsort((keys, texts))
    same = (texts[order[1:]] == texts[order[:-1]]) & (keys[order[1:]] == keys[order[:-1]])
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _base(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of whole texts. Lines and windows are compared by 64-bit hashes within their text."""
    n = len(offsets) - 1
    starts, ends, ranges = W.word_spans(data, offsets)
    text = np.arange(n)
    whole = np.concatenate([[0], np.cumsum(_CLASS[data] != _INSIDE)])
    per = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ranges])
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, list(SYMBOLS)))])
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    of_line = np.searchsorted(offsets[1:], line_starts, "right")
    keep = of_line < n  # behind the last byte there is no line with a word
    line_starts, of_line = line_starts[keep], of_line[keep]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[1:][of_line])
    line_ends -= (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else 0
    spoken = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    of_line, keys = of_line[spoken], W.span_hashes(data, line_starts[spoken], line_ends[spoken])
    order = np.lexsort((keys, of_line))
    again = (of_line[order[1:]] == of_line[order[:-1]]) & (keys[order[1:]] == keys[order[:-1]])
    windows = W.inner_starts(ranges, WINDOW)
    grams = W.gram_hashes(W.span_hashes(data, starts, ends), WINDOW)[windows]
    hit = windows[_repeats(np.searchsorted(ranges, windows, "right"), grams)]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return {
        "n_words": np.diff(ranges),
        "word_chars": per(whole[ends] - whole[starts]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.bincount(of_line[order[1:]][again], minlength=n)[text],
        "n_repeat_words": per((np.cumsum(cover)[:-1] > 0).astype(np.int64)),
    }


def quality(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``,
    ``char_distance``, ``word_distance`` of each row of ``docs(doc_id, text, lang)``.

    Base rules fail texts of fewer than 20 words or with more than 30 of 100 words in repeated 8-word windows. A text that passes
    is kept unless a histogram that is long enough to be judged (200 characters, 50 words) is further from its language's
    reference than the limit. A text whose language is null or has no reference is held against all references, of which the
    nearest counts; without references nothing is judged. Distances are null where not judged. Null texts are empty and fail. Rows
    that repeat, and null ids, are returned as they are; other columns are ignored. References are made from ``docs`` if none are given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs or references(docs))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", *longs, "base_failed", "kept", "char_distance", "word_distance"]

    def run(batches):
        refs = shared.value
        for batch in batches:
            langs = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
            for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
                base = _base(data, offsets)
                lower = W.lower_ascii(data)
                starts, ends, ranges = W.word_spans(lower, offsets)
                chars, words = _distances(refs, langs[i:j], _class_counts(data, offsets), W.span_hashes(lower, starts, ends), ranges)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                kept = ~failed & ~(chars > CHAR_DISTANCE) & ~(words > WORD_DISTANCE)
                far = [pa.array(d, pa.float64(), mask=np.isnan(d)) for d in (chars, words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(base[c], pa.int64()) for c in longs], pa.array(failed), pa.array(kept), *far], names)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, schema)
