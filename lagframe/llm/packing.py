"""Packing by cutting-stock column generation: a linear program over length-histogram patterns, priced by a knapsack."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as K
from .scratch import store

CAPACITY, END_ID = 2048, 1
#: Lengths are planned in steps of so many tokens, rounded up; the program has CAPACITY / STEP rows for any corpus.
STEP = 8
#: The relaxation counts as solved this close to its lower bound.
CLOSE = 5e-4
#: Padding to tokens from which rests are cut on, and how many halvings of the capacity they can be cut at.
PADDING, CUTS = 0.02, 6
#: Rows of one length that one task ranks at most, about.
RANKED = 20_000


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut each document's ids, with id 1 behind them, into full pieces and a rest: ``doc_id``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``. A rest can be cut on (:func:`cut`): ``heads`` has the checksums of its parts of half, a
    quarter, ... of the capacity (null where the length lacks that binary digit), ``tails`` of what is left behind each."""
    path = path or K.default_path()

    def run(batches):
        for batch in batches:
            for i, j, ids, at in K.encoded(batch.column("text"), path):
                ids = np.insert(ids, at[1:], END_ID).astype("<u4")
                at = at + np.arange(len(at))
                total = np.diff(at)
                per = -(-total // capacity)
                of = np.repeat(np.arange(j - i), per)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)) * capacity
                length = np.minimum(capacity, total[of] - start)
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip((at[of] + start).tolist(), length.tolist(), strict=True)]
                heads, tails = [], []
                for a, n in zip((at[of] + start).tolist(), length.tolist(), strict=True):
                    if n == capacity:
                        heads.append(None), tails.append(None)
                        continue
                    head, tail, end = [], [], a + n
                    for size in _halves(capacity):
                        head.append(zlib.crc32(ids[a : a + size]) if n & size else None)
                        a += n & size
                        tail.append(zlib.crc32(ids[a:end]) if a < end else None)
                    heads.append(head), tails.append(tail)
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(of)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[of]), pa.array(heads, kind), pa.array(tails, kind)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "heads", "tails"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, heads array<long>, tails array<long>")


def _halves(capacity: int) -> list[int]:
    return [capacity >> k for k in range(1, CUTS + 1)]


def cut(parts: DataFrame, level: int, capacity: int = CAPACITY) -> DataFrame:
    """Cut each rest into its binary parts of the first ``level`` halvings of the capacity, and what is left."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if not level:
        return parts.select(columns)
    made, before = [], F.lit(0).cast("long")
    for k, size in enumerate(_halves(capacity)[:level]):
        has = F.col("length").bitwiseAND(size)
        made.append(F.when(has > 0, F.struct((F.col("start") + before).alias("start"), F.lit(size).cast("long").alias("length"), F.col("heads")[k].alias("ids_crc32"))))
        before = before + has
    left = F.col("length") - before
    made.append(F.when(left > 0, F.struct((F.col("start") + before).alias("start"), left.alias("length"), F.col("tails")[level - 1].alias("ids_crc32"))))
    whole = F.array(F.struct("start", "length", "ids_crc32"))
    each = parts.select("doc_id", "doc_tokens", F.explode(F.when(F.col("heads").isNull(), whole).otherwise(F.array_compact(F.array(*made)))).alias("p"))
    return each.select("doc_id", "p.*", "doc_tokens").select(columns)


def _cut_counts(lengths: dict[int, int], level: int, capacity: int, step: int) -> dict[int, int]:
    """The histogram of planned sizes that a level of cutting gives."""
    out: dict[int, int] = {}
    for n, often in lengths.items():
        parts = [n & size for size in _halves(capacity)[:level]] if n < capacity else []
        for part in [*parts, n - sum(parts)]:
            if part:
                out[-(-part // step)] = out.get(-(-part // step), 0) + often
    return out


def _plan(counts: dict[int, int], room: int) -> list[tuple[np.ndarray, int]]:
    own = sorted(x for x in counts if x < room)
    return patterns(np.array(own, np.int64), np.array([counts[x] for x in own]), room) if own else []


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items (any number of each) that fits, by dynamic programming over the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(size, np.arange(room + 1), "right").tolist()
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := fitting[c]:
            gain = best[c - size[:n]]
            gain += value[:n]
            k = gain.argmax()
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    pattern, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= int(size[last[c]])
    return float(best[room]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps with row exchanges, on one core: a busy driver host makes threaded linear algebra crawl."""
    m = len(a)
    both = np.concatenate([a, np.eye(m)], axis=1)
    for k in range(m):
        r = k + int(np.abs(both[k:, k]).argmax())
        both[[k, r]] = both[[r, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= rest[:, None] * both[k]
    return both[:, m:]


def patterns(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(items of each size, how often) that together hold ``demand[i]`` items of ``size[i]`` or more, in few bins of ``room``.

    The linear relaxation is solved by the revised simplex method with columns from the knapsack; patterns are rounded down,
    and what is left (fewer items than sizes times patterns, whatever the demand) is placed first-fit by falling size.
    """
    order = np.argsort(size)
    size, demand = size[order], demand[order].astype(np.float64)
    m = len(size)
    basis = np.diag(room // size).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(basis))
    x = np.einsum("ij,j->i", inverse, demand)
    lowest = 0.0  # the relaxation's value is at least this: sum of dual prices over the best column's worth, or sheer volume
    for turn in range(rounds):
        dual = inverse.sum(axis=0)
        worth, column = _knapsack(np.maximum(dual, 0), size, room)
        lowest = max(lowest, float(dual @ demand) / max(worth, 1.0), float(size @ demand) / room)
        if worth <= 1 + 1e-7 or x.sum() <= lowest * (1 + CLOSE) + 0.9:  # or less than one bin is left to win
            break
        step = np.einsum("ij,j->i", inverse, column.astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        r = int(ratio.argmin())
        basis[:, r] = column
        if turn % 200 == 199:
            inverse = _inverse(basis)
            x = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
        else:
            pivot = inverse[r] / step[r]
            inverse -= np.outer(step, pivot)
            inverse[r] = pivot
            x = np.maximum(x - ratio[r] * step, 0)
            x[r] = ratio[r]
    out: dict[tuple, int] = {}
    left = demand.astype(np.int64)
    for k in np.argsort(-x):
        items = basis[:, k].astype(np.int64)
        used = items > 0
        often = min(int(x[k] + 1e-6), int((left[used] // items[used]).min()) if used.any() else 0)
        if often > 0:
            out[tuple(items)] = out.get(tuple(items), 0) + often
            left = left - often * items
    while left.any():
        items, free = np.zeros(m, np.int64), room
        for k in range(m - 1, -1, -1):
            items[k] = min(left[k], free // size[k])
            free -= int(items[k] * size[k])
        often = max(1, int((left[items > 0] // items[items > 0]).min()))
        out[tuple(items)] = out.get(tuple(items), 0) + often
        left = left - often * items
    back = np.argsort(order)
    return [(np.array(p)[back], n) for p, n in out.items()]


def pack(parts: DataFrame, capacity: int = CAPACITY, step: int = STEP, plan: list[tuple[np.ndarray, int]] | None = None) -> DataFrame:
    """Give every row of ``parts`` (``length`` from 1 to ``capacity``) a ``sequence_id`` and a gapless ``offset`` in it.

    Only the histogram of planned lengths comes to the driver: ``capacity / step`` counts. Rows of one length are ranked by
    salted windows and their ranks are dealt over the patterns' slots, so a length that a third of all rows share is no
    bottleneck. Read twice: pass a stored table. ``plan`` spares solving again what was solved for the same histogram.
    """
    sized = parts.withColumn("size", F.ceil(F.col("length") / step).cast("int"))
    counts = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity / step rows
    room = capacity // step
    own = np.array(sorted(s for s in counts if s < room), np.int64)
    plan = _plan(counts, room) if plan is None else plan
    slots: dict[int, list[tuple[int, ...]]] = {room: [(0, 1, 0, 0)]}
    base = counts.get(room, 0)
    for items, often in plan:
        slot = 0
        for s, a in sorted(zip(own.tolist(), items.tolist(), strict=True), reverse=True):
            if a:
                before = slots.setdefault(s, [])
                first = before[-1][0] + before[-1][4] if before else 0
                before.append((first, a, base, slot, a * often))
                slot += a
        base += often
    table = {s: np.array([x[:4] for x in rows], np.int64) for s, rows in slots.items()}
    shared = parts.sparkSession.sparkContext.broadcast(table)
    salts = max(1, -(-max(counts.values(), default=1) // RANKED))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("size", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order)).join(before, ["size", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    keep = parts.columns
    names = [*keep, "sequence_id", "slot"]

    def deal(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("size", "rank"))
            sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                rows, at = shared.value[int(s)], np.flatnonzero(size == s)
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                inside = rank[at] - rows[k, 0]
                sequence[at] = rows[k, 2] + inside // rows[k, 1]
                slot[at] = rows[k, 3] + inside % rows[k, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(slot)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    dealt = ranked.select(*keep, "size", "rank").mapInArrow(deal, f"{kinds}, sequence_id long, slot long")
    behind = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("offset", F.sum("length").over(behind) - F.col("length")).drop("slot")


def packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids, one row a piece.

    Documents are cut at full sequences; if their rests leave more than ``PADDING`` unfilled in the best patterns, all rests
    are cut on at powers of two, at as few as it takes. A null or empty text is the single id 1. Every row of ``docs`` is a
    document of its own, repeated ids and null ids included; other columns are ignored. The 50,257-id byte-level BPE is the
    default; ``path`` names another.
    """
    parts = store(pieces(docs, path))
    lengths = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most 2048 rows
    tokens = sum(n * often for n, often in lengths.items())
    for level in range(CUTS + 1):
        counts = _cut_counts(lengths, level, CAPACITY, STEP)
        plan = _plan(counts, CAPACITY // STEP)
        bins = sum(often for _, often in plan) + counts.get(CAPACITY // STEP, 0)
        if bins <= tokens / CAPACITY * (1 + PADDING) + 1:
            break
    return pack(cut(parts, level), plan=plan)
