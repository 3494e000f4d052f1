"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import drop, store, store_filtered

#: Words of the runs from which a window's anchor is chosen; words whose windows a reference block holds.
GRAM, BLOCK = 10, 256


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows within a text: flat start, anchor (least hash of a run in it); each text's range; word hashes.

    Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a text has few of them.
    """
    starts, ends, ranges = W.word_spans(data, offsets)
    words = W.span_hashes(data, starts, ends)
    gram = min(GRAM, window)
    low, width, reach = W.gram_hashes(words, gram), 1, window - gram + 1
    while width * 2 <= reach:
        low, width = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0], width * 2
    if reach > width:
        low = np.minimum(low[: -(reach - width)], low[reach - width :]) if len(low) > reach - width else low[:0]
    at = W.inner_starts(ranges, window)
    return at, low[at], np.searchsorted(at, ranges), words


def _sha(text: np.ndarray, place: np.ndarray, a: int, b: int) -> str:
    """SHA-256 of the words [a, b) joined by a space."""
    return hashlib.sha256(text[place[a] : max(place[a], place[b] - 1)]).hexdigest()


def _survey(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("h")
            for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
                at, low, ranges, _ = _anchors(data, offsets, window)
                starts, ends, own = W.word_spans(data, offsets)
                text, place = W.joined(data, starts, ends)
                count, sha, anchors = np.diff(own), [], []
                for d in range(j - i):
                    sha.append(_sha(text, place, own[d], own[d + 1]))
                    anchors.append(np.unique(low[ranges[d] : ranges[d + 1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), keys.slice(i, j - i), pa.array(count, pa.int64()), pa.array(sha), pa.array(anchors, pa.list_(pa.int64()))], ["doc_id", "h", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, h long, n_words long, sha string, anchors array<long>")


def _windows(repeated: DataFrame, window: int) -> DataFrame:
    """Hash and first start of every distinct window whose anchor other documents have too."""

    def run(batches):
        for batch in batches:
            ids, keys, wanted = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy(), batch.column("shared")
            for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
                at, low, ranges, words = _anchors(data, offsets, window)
                whole = W.rolling_hashes(words, window)
                starts = W.word_spans(data, offsets)[2]
                out: list[list[np.ndarray]] = [[], [], [], []]
                for d in range(j - i):
                    a, b = ranges[d], ranges[d + 1]
                    hit = at[a:b][np.isin(low[a:b], np.asarray(wanted[i + d].values).view(np.uint64))]
                    own, where = np.unique(whole[hit], return_index=True)
                    for k, x in enumerate((np.full(len(own), ids[i + d]), np.full(len(own), keys[i + d]), hit[where] - starts[d], own.view(np.int64))):
                        out[k].append(x)
                flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
                for k in range(0, len(flat[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)].astype(np.int64)) for x in flat], ["doc_id", "h", "pos", "hash"])

    return repeated.mapInArrow(run, "doc_id long, h long, pos long, hash long")


def _blocks(owners: DataFrame, window: int) -> DataFrame:
    """Of each wanted block (``BLOCK`` window starts) the words that its windows from the first wanted start to the last cover."""

    def run(batches):
        for batch in batches:
            ids, keys, wanted = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy(), batch.column("wanted")
            for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
                starts, ends, ranges = W.word_spans(data, offsets)
                text, place = W.joined(data, starts, ends)
                for d in range(j - i):
                    blocks, first, last = (np.asarray(x) for x in wanted[i + d].values.flatten())
                    a, b = ranges[d] + first, ranges[d] + last + window
                    texts = [text[place[x] : place[y] - 1].tobytes() for x, y in zip(a, b, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), ids[i + d])), pa.array(np.full(len(blocks), keys[i + d])), pa.array(blocks), pa.array(first), pa.array(texts, pa.binary()).cast(pa.string())], ["ref", "ref_h", "block", "at", "words"])

    return owners.select("doc_id", "h", "text", "wanted").mapInArrow(run, "ref long, ref_h long, block long, at long, words string")


def factor_spans(doc: tuple[np.ndarray, np.ndarray], refs: tuple[np.ndarray, np.ndarray], ranges: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy parse of a document relative to its reference blocks; the factors of ``window`` words or more, as [start, end).

    Both sides are words joined by a space and their places (see :func:`words.joined`); ``ranges`` has each block's words. At
    each place the longest match in any block becomes a factor, and the parse goes on behind it. A window may also lie
    across a factor's end, so the places from which a window reaches over the end are looked up before. Hashes of windows
    find the matches, and a factor's bytes are compared with the block's.
    """
    (text, place), (ref_text, ref_place) = doc, refs
    own, ref = (W.span_hashes(t, p[:-1], p[1:] - 1) for t, p in (doc, refs))
    at = W.inner_starts(ranges, window)
    known = W.rolling_hashes(ref, window)[at]
    order = np.argsort(known, kind="stable")
    known, at = known[order], at[order]
    stop = ranges[np.searchsorted(ranges, at, "right")]
    asked = W.rolling_hashes(own, window)
    low, high = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
    hits = np.flatnonzero(high > low)
    spans, p, k = [], 0, 0
    while (k := k + int(np.searchsorted(hits[k:], p))) < len(hits):
        p, best = int(hits[k]), 0
        for c in range(low[p], high[p]):
            q = int(at[c])
            m = min(len(own) - p, int(stop[c]) - q)
            if m > best:
                differ = own[p : p + m] != ref[q : q + m]
                m = int(differ.argmax()) if differ.any() else m
                if m > best and m >= window and np.array_equal(text[place[p] : place[p + m] - 1], ref_text[ref_place[q] : ref_place[q + m] - 1]):
                    best = m
        if best:
            spans.append((p, p + best))
        p += max(1, best - window + 1)
    return spans


def _cut(doc: DataFrame, window: int) -> DataFrame:
    """One document at a time, whatever a batch holds: memory is bounded by a text and its own blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, refs = batch.column("text").slice(i, 1), batch.column("refs")[i].values
                data, offsets = W.text_bytes(own)
                text, place = W.joined(data, *W.word_spans(data, offsets)[:2])
                data, offsets = W.text_bytes(refs)
                starts, ends, ranges = W.word_spans(data, offsets)
                spans = factor_spans((text, place), W.joined(data, starts, ends), ranges, window)
                keep = np.ones(len(place) - 1, bool)
                merged: list[list[int]] = []
                for a, b in spans:
                    keep[a:b] = False
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept = text[np.repeat(keep, np.diff(place))][:-1].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("h").slice(i, 1), pa.array([int((~keep).sum())], pa.int64()), pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept.decode()]), pa.array([merged], pa.list_(pa.list_(pa.int64())))], ["doc_id", "h", "cut", "cut_sha", "kept", "spans"])

    return doc.select("doc_id", "h", "text", "refs").mapInArrow(run, "doc_id long, h long, cut long, cut_sha string, kept string, spans array<array<long>>")


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove every word covered by a ``window``-word run that also starts in a document with a smaller id.

    One row per row of ``docs`` that has an id: ``doc_id``, ``h`` (xxhash64 of the text; equal rows have equal keys),
    ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, joined by a space), ``kept`` (those words; null where
    nothing was removed) and ``spans`` (removed word ranges, null where none).

    Words are runs of characters other than ASCII white space; null or empty texts have none. Windows are judged on the
    input. Rows with a null id are left out; rows of one id are never references to each other, and each is returned.
    Columns other than ``doc_id`` and ``text`` are ignored.

    1. Every window has an anchor, the least hash of the runs of words in it; only anchors that two ids have go on.
    2. The windows at those anchors are counted by hash: the smallest id with a window owns it.
    3. The owners' words around owned windows are the indexed reference blocks. Each document meets the blocks that own
       its windows, each block once and cut to the span of the windows it owns for the document, and is parsed against
       them word for word. So a passage in a third of all documents has one block, and a document whose neighbouring
       windows all have different owners meets ``window`` words for each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    survey = store(_survey(docs, window))
    anchors = survey.select("doc_id", "h", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    wanted = store(anchors.join(shared, "anchor").groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("shared")))
    repeated = store_filtered(docs.join(wanted.where("size(shared) > 0"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]))
    drop(wanted)
    windows = store(_windows(repeated, window))
    owners = windows.groupBy("hash").agg(F.min(F.struct("doc_id", "h", "pos")).alias("o"), F.max("doc_id").alias("last")).where("o.doc_id < last").select("hash", F.col("o.doc_id").alias("ref"), F.col("o.h").alias("ref_h"), F.col("o.pos").alias("start"))
    met = windows.join(owners, "hash").where("ref < doc_id").groupBy("doc_id", "h", "ref", "ref_h", F.expr(f"start div {BLOCK}").alias("block"))
    hits = store(met.agg(F.min("start").alias("first"), F.max("start").alias("last")))
    drop(windows)
    whole = hits.groupBy(F.col("ref").alias("doc_id"), F.col("ref_h").alias("h"), "block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    needed = whole.groupBy("doc_id", "h").agg(F.collect_list(F.struct("block", "first", "last")).alias("wanted"))
    blocks = _blocks(repeated.join(needed, ["doc_id", "h"]), window)
    own = F.array_join(F.slice(F.split("words", " "), (F.col("first") - F.col("at") + 1).cast("int"), (F.col("last") - F.col("first") + window).cast("int")), " ")
    refs = hits.join(blocks, ["ref", "ref_h", "block"]).groupBy("doc_id", "h").agg(F.collect_list(own).alias("refs"))
    cut = _cut(repeated.join(refs, ["doc_id", "h"]), window)
    out = survey.select("doc_id", "h", "n_words", "sha").join(cut, ["doc_id", "h"], "left")
    return out.select("doc_id", "h", "n_words", F.coalesce("cut", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), F.when(F.col("cut") > 0, F.col("kept")).alias("kept"), F.when(F.col("cut") > 0, F.col("spans")).alias("spans"))
