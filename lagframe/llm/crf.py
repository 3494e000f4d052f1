"""Linear-chain conditional random fields over words, trained and applied with numpy.

A word's features are hashed: prefixes of 2 to 8 and suffixes of 2 to 4 bytes, the word itself, its byte trigrams, and its place in a learned
lexicon. Transitions between neighbouring words' labels are learned too, all by L-BFGS to a small gradient. A text is one chain,
whatever its length: it is worked on in blocks of ``BLOCK`` words, side by side, and messages are carried over the blocks'
borders. Words are taken with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import words as W

BLOCK, TABLE_BITS, MOST = 64, 18, 1 << 23
_PREFIXES, _SUFFIXES = (2, 3, 4, 5, 6, 7, 8), (2, 3, 4)
_KINDS = [*(f"p{k}" for k in _PREFIXES), *(f"s{k}" for k in _SUFFIXES), "word", "tri", "lex"]
_KIND = dict(zip(_KINDS, W.mix64(np.arange(1, len(_KINDS) + 1, dtype=np.uint64)), strict=True))


@dataclass
class Model:
    """``weights`` (2**bits, labels); ``start`` and ``transitions`` are log potentials; ``lexicon`` maps sorted word hashes to entries."""

    labels: list
    weights: np.ndarray
    start: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    entry: np.ndarray

    def pieces(self, column: pa.Array) -> Iterator[Piece]:
        """Texts to be labelled, in the order of the column."""
        return pieces(column, self.lexicon, self.entry, bits=len(self.weights).bit_length() - 1)


def table_bits(labels: int) -> int:
    """Rows of the weights as a power of two: fewer for more labels, so that a model has ``MOST`` weights at most (from 2**8 rows on)."""
    return max(8, min(TABLE_BITS, (MOST // max(1, labels)).bit_length() - 1))


def _slot(h: np.ndarray, kind: str, bits: int = TABLE_BITS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (W.mix64(h + _KIND[kind]) >> np.uint64(64 - bits)).astype(np.int64)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, lexicon: np.ndarray, entry: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words' features end to end, and where each word's begin."""
    n = len(starts)
    fixed = [_slot(whole, "word", bits)]
    fixed += [_slot(W.span_hashes(data, starts, np.minimum(starts + k, ends)), f"p{k}", bits) for k in _PREFIXES]
    fixed += [_slot(W.span_hashes(data, np.maximum(ends - k, starts), ends), f"s{k}", bits) for k in _SUFFIXES]
    at = np.searchsorted(lexicon, whole)
    known = (at < len(lexicon)) & (lexicon[np.minimum(at, max(0, len(lexicon) - 1))] == whole) if len(lexicon) else np.zeros(n, bool)
    place = np.zeros(n, np.uint64)
    place[known] = entry[at[known]].astype(np.uint64) + np.uint64(1)
    fixed.append(_slot(W.mix64(place), "lex", bits))
    grams = np.maximum(ends - starts - 2, 0)
    first = np.concatenate([[0], np.cumsum(grams + len(fixed))])
    out = np.empty(first[-1], np.int64)
    for k, f in enumerate(fixed):
        out[first[:-1] + k] = f
    if grams.any():
        word = np.repeat(np.arange(n), grams)
        inner = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        p = starts[word] + inner
        tri = data[p].astype(np.uint64) | (data[p + 1].astype(np.uint64) << np.uint64(8)) | (data[p + 2].astype(np.uint64) << np.uint64(16))
        out[first[word] + len(fixed) + inner] = _slot(W.mix64(tri), "tri", bits)
    return out, first


@dataclass
class Piece:
    """Words of some texts: distinct words, their features, and where each word stands in its text's blocks."""

    rows: tuple[int, int]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ranges: np.ndarray
    hashes: np.ndarray
    distinct: np.ndarray
    inverse: np.ndarray
    slots: np.ndarray
    first: np.ndarray
    block: np.ndarray
    place: np.ndarray
    lengths: np.ndarray
    blocks: np.ndarray


def pieces(column: pa.Array, lexicon: np.ndarray, entry: np.ndarray, size: int = 0, bits: int = TABLE_BITS) -> Iterator[Piece]:
    for i, j, data, offsets in W.chunks(*W.text_bytes(column), size):
        data = W.lower_ascii(data)
        starts, ends, ranges = W.word_spans(data, offsets)
        hashes = W.span_hashes(data, starts, ends)
        _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slots, first = features(data, starts[where], ends[where], hashes[where], lexicon, entry, bits)
        n = np.diff(ranges)
        blocks = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
        pos = np.arange(len(starts)) - np.repeat(ranges[:-1], n)
        block = np.repeat(blocks[:-1], n) + pos // BLOCK
        yield Piece((i, j), data, starts, ends, ranges, hashes, where, inverse, slots, first, block, pos % BLOCK, np.bincount(block, minlength=int(blocks[-1])), blocks)


def _scores(slots: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Label scores of words from their features."""
    return np.add.reduceat(weights[slots], first[:-1], axis=0) if len(first) > 1 else np.zeros((0, weights.shape[1]), weights.dtype)


def _emissions(score: np.ndarray) -> np.ndarray:
    """Exponentials of scores, the largest label's being 1."""
    return np.exp(np.clip(score - score.max(axis=1, keepdims=True), -60, 0)).astype(np.float32) if len(score) else score.astype(np.float32)


#: From so many labels on, messages over block borders are carried as vectors, a block after the other, instead of as matrices.
WIDE = 32


def _carried(piece: Piece, x: np.ndarray, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each block from outside: the forward message at its first word, and the backward one at its last."""
    n, labels = len(piece.lengths), len(s)
    into, behind = np.tile(s / s.sum(), (n, 1)), np.ones((n, labels), np.float32)
    per = np.diff(piece.blocks)
    if n and per.max() > 1:
        (_carry_vectors if labels >= WIDE else _carry_matrices)(piece, x, t, into, behind, per)
    return into, behind


def _carry_vectors(piece: Piece, x: np.ndarray, t: np.ndarray, into: np.ndarray, behind: np.ndarray, per: np.ndarray) -> None:
    """The k-th blocks of all texts in step: labels ** 2 work a word, and 64 steps a block of the longest text."""
    for k in range(1, int(per.max())):
        b = piece.blocks[:-1][per > k] + k
        v = into[b - 1]
        for j in range(BLOCK):
            v = (v @ t if j else v) * x[j, b - 1]
            v /= v.sum(axis=1, keepdims=True)
        v = v @ t
        into[b] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(per.max()) - 1, 0, -1):
        b = piece.blocks[:-1][per > k] + k
        v = behind[b]
        for j in range(BLOCK - 1, -1, -1):
            step = (x[j, b] * v) @ t.T
            v = np.where((piece.lengths[b] > j)[:, None], step / step.sum(axis=1, keepdims=True), v)
        behind[b - 1] = v


def _carry_matrices(piece: Piece, x: np.ndarray, t: np.ndarray, into: np.ndarray, behind: np.ndarray, per: np.ndarray) -> None:
    """A block's effect on a message is one matrix, the product of its words' emissions and the transitions between them. The
    products of all blocks are made side by side; only the few steps from block to block of a text come after each other."""
    n, labels = into.shape
    own = np.flatnonzero(np.repeat(per > 1, per))
    m = np.zeros((len(own), labels, labels), np.float32)
    m[:, np.arange(labels), np.arange(labels)] = x[0, own]
    for k in range(1, BLOCK):
        step = (m.reshape(-1, labels) @ t).reshape(m.shape) * x[k, own][:, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        m = np.where((piece.lengths[own] > k)[:, None, None], step, m)
    at = np.full(n, -1)
    at[own] = np.arange(len(own))
    for k in range(1, int(per.max())):
        b = piece.blocks[:-1][per > k] + k
        v = (into[b - 1][:, None, :] @ m[at[b - 1]])[:, 0] @ t
        into[b] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(per.max()) - 1, 0, -1):
        b = piece.blocks[:-1][per > k] + k
        v = (m[at[b]] @ behind[b][:, :, None])[:, :, 0] @ t.T
        behind[b - 1] = v / v.sum(axis=1, keepdims=True)


@dataclass
class Expected:
    """Log normalisers of the texts, and weighted sums over them of expected first labels and label transitions."""

    log_z: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    moves: np.ndarray


def forward_backward(piece: Piece, model: Model, weigh: Callable[[np.ndarray], np.ndarray] | None = None, score: np.ndarray | None = None) -> tuple[np.ndarray, Expected | None]:
    """Label marginals of each word; with ``weigh``, which gives texts' weights from their log normalisers, also expected counts.

    ``score`` are the label scores of the distinct words, where they are known already.
    """
    labels, n = len(model.labels), len(piece.lengths)
    score = _scores(piece.slots, piece.first, model.weights) if score is None else score
    x = np.ones((BLOCK, n, labels), np.float32)
    x[piece.place, piece.block] = _emissions(score)[piece.inverse]
    t, s = np.exp(model.transitions).astype(np.float32), np.exp(model.start).astype(np.float32)
    into, behind = _carried(piece, x, t, s)
    longest = int(piece.lengths.max()) if n else 0
    alpha, logs = np.empty_like(x), np.zeros(n)
    for k in range(longest):
        a = (alpha[k - 1] @ t if k else into) * x[k]
        total = a.sum(axis=1, keepdims=True)
        alpha[k] = a / total
        if weigh:
            logs += np.where(piece.lengths > k, np.log(total[:, 0].astype(np.float64)), 0)
    expected, later = None, np.zeros(0, int)
    if weigh:
        head = np.zeros(n + 1, bool)
        head[piece.blocks] = True
        later = np.flatnonzero(~head[:-1])
        logs[head[:-1]] += np.log(s.sum(dtype=np.float64))
        logs[later] += np.log((alpha[BLOCK - 1][later - 1] @ t).sum(axis=1, dtype=np.float64))
        top = np.concatenate([[0], np.cumsum(score.max(axis=1)[piece.inverse].astype(np.float64))]) if len(score) else np.zeros(1)
        z = np.diff(np.concatenate([[0], np.cumsum(logs)])[piece.blocks]) + np.diff(top[piece.ranges])
        weights = weigh(z)
        per_block = np.repeat(weights, np.diff(piece.blocks))
        expected = Expected(z, weights, np.zeros(labels), np.zeros((labels, labels)))

    def add_moves(before: np.ndarray, after: np.ndarray, weight: np.ndarray) -> None:
        """Sums of weighted joint marginals, which are before x t x after, scaled to one."""
        scale = weight / ((before @ t) * after).sum(axis=1)
        expected.moves += (before.T.astype(np.float64) @ (after * scale[:, None])) * t

    beta = behind
    marginal = np.empty_like(x)
    for k in range(longest - 1, -1, -1):
        if k + 1 < longest:
            b = x[k + 1] * beta
            inside = piece.lengths > k + 1
            if weigh:
                add_moves(alpha[k][inside], b[inside], per_block[inside])
            b = b @ t.T
            beta = np.where(inside[:, None], b / b.sum(axis=1, keepdims=True), behind)
        m = alpha[k] * beta
        marginal[k] = m / m.sum(axis=1, keepdims=True)
    if weigh and n:
        expected.starts += (marginal[0] * per_block[:, None])[head[:-1]].sum(axis=0)
        add_moves(alpha[BLOCK - 1][later - 1], (x[0] * beta)[later], per_block[later])
    return marginal[piece.place, piece.block], expected


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 200, tolerance: float = 1e-4, memory: int = 6) -> np.ndarray:
    """L-BFGS with backtracking, until the gradient is shorter than ``tolerance`` times the larger of 1 and the point's length."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        d, kept = g.copy(), []
        for s, y, r in reversed(pairs):
            kept.append(r * (s @ d))
            d -= kept[-1] * y
        d *= 1 / (pairs[-1][2] * (pairs[-1][1] @ pairs[-1][1])) if pairs else 1 / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            d += (a - r * (y @ d)) * s
        slope, size = -(g @ d), 1.0
        while True:
            new = x - size * d
            v, h = f(new)
            if v <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if v > value:  # no step helps: the sums' precision is used up
            break
        s, y = new - x, h - g
        if s @ y > 1e-10 * (y @ y):
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        x, value, g = new, v, h
    return x


class Sample:
    """Texts to learn from: each distinct word's features are made once for all of them."""

    def __init__(self, texts: list[str], labels: list, lexicon: np.ndarray, entry: np.ndarray) -> None:
        self.labels, self.lexicon, self.entry = labels, lexicon, entry
        bits = table_bits(len(labels))
        self.pieces = list(pieces(pa.array(texts, pa.string()), lexicon, entry, (1 << 20) // max(1, len(labels)), bits))
        hashes = np.concatenate([p.hashes[p.distinct] for p in self.pieces]) if self.pieces else np.zeros(0, np.uint64)
        known, where = np.unique(hashes, return_index=True)
        slots = np.concatenate([p.slots for p in self.pieces]) if self.pieces else np.zeros(0, np.int64)
        counts = np.concatenate([np.diff(p.first) for p in self.pieces]) if self.pieces else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        self.first = np.concatenate([[0], np.cumsum(counts[where])])
        own = np.repeat(ends[where] - counts[where] - self.first[:-1], counts[where]) + np.arange(self.first[-1])
        self.active, self.slots = np.unique(slots[own], return_inverse=True)
        self.size = 1 << bits
        for p in self.pieces:
            p.distinct, p.inverse = known, np.searchsorted(known, p.hashes)
            p.slots, p.first = self.slots, self.first
        self.words = sum(len(p.hashes) for p in self.pieces)

    def unpack(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, a = len(self.labels), len(self.active)
        return x[: a * n].reshape(a, n), x[a * n : a * n + n], x[a * n + n :].reshape(n, n)

    def objective(self, x: np.ndarray, evidence: Callable, ridge: float, smooth: float = 1e-3) -> tuple[float, np.ndarray]:
        """Negative log likelihood with a ridge, and its gradient.

        ``evidence(piece, score, model)`` gives a function from log normalisers to (loss, weights of the expected counts),
        and real counts (by word and label, of first labels, of moves) as functions of those weights.
        """
        w, start, moves = self.unpack(x)
        score = _scores(self.slots, self.first, w)
        model = Model(self.labels, w, start, moves, self.lexicon, self.entry)
        loss, g_word, g_start, g_moves = 0.0, np.zeros(score.shape), smooth * start, smooth * moves
        for p in self.pieces:
            if not len(p.hashes):
                continue
            weigh, real = evidence(p, score, model)
            marginal, e = forward_backward(p, model, lambda z, weigh=weigh: weigh(z)[1], score)
            loss += weigh(e.log_z)[0]
            tag, r_start, r_moves = real(e.weights)
            weight = np.repeat(e.weights, np.diff(p.ranges))
            gap = marginal * weight[:, None]
            gap[np.arange(len(tag)), tag] -= weight
            for k in range(len(self.labels)):
                g_word[:, k] += np.bincount(p.inverse, gap[:, k], len(g_word))
            g_start += e.starts - r_start
            g_moves += e.moves - r_moves
        of = np.repeat(np.arange(len(g_word)), np.diff(self.first))
        g_w = np.stack([np.bincount(self.slots, g_word[of, k], len(self.active)) for k in range(len(self.labels))], axis=1) + ridge * w
        value = loss + ridge / 2 * float((w * w).sum()) + smooth / 2 * float((start**2).sum() + (moves**2).sum())
        return value, np.concatenate([g_w.ravel(), g_start, g_moves.ravel()])

    def model(self, x: np.ndarray) -> Model:
        w, start, moves = self.unpack(x)
        weights = np.zeros((self.size, len(self.labels)), np.float32)
        weights[self.active] = w
        return Model(self.labels, weights, start.copy(), moves.copy(), self.lexicon, self.entry)

    def zeros(self) -> np.ndarray:
        n = len(self.labels)
        return np.zeros(len(self.active) * n + n + n * n)


def real_counts(piece: Piece, tag: np.ndarray, weights: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted first labels and moves of labelled words."""
    head = np.zeros(len(tag), bool)
    full = np.flatnonzero(np.diff(piece.ranges) > 0)
    head[piece.ranges[:-1][full]] = True
    inner, of = np.flatnonzero(~head), np.repeat(weights, np.diff(piece.ranges))
    moves = np.bincount(tag[inner - 1] * labels + tag[inner], of[inner], labels * labels).reshape(labels, labels)
    return np.bincount(tag[head], of[head], labels), moves


def tagged(tags: list[np.ndarray], labels: int) -> Callable:
    """Evidence of labelled words: ``tags[i]`` has a label index for each word of the i-th text."""

    def evidence(piece: Piece, score: np.ndarray, model: Model):
        tag = np.concatenate([tags[d] for d in range(*piece.rows)])
        ones = np.ones(piece.rows[1] - piece.rows[0])
        start, moves = real_counts(piece, tag, ones, labels)
        own = float(score[piece.inverse, tag].sum(dtype=np.float64) + (start * model.start).sum() + (moves * model.transitions).sum())
        return lambda z: (float(z.sum()) - own, ones), lambda _: (tag, start, moves)

    return evidence


def train(texts: list[str], tags: list[np.ndarray], labels: list, lexicon: np.ndarray, entry: np.ndarray, ridge: float = 1.0, steps: int = 60, tolerance: float = 0.03) -> Model:
    """Maximum conditional likelihood of labelled words, with a ridge on the features' weights."""
    sample = Sample(texts, labels, lexicon, entry)
    evidence = tagged(tags, len(labels))
    return sample.model(minimise(lambda x: sample.objective(x, evidence, ridge), sample.zeros(), steps, tolerance))
