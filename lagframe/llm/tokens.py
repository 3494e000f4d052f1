"""Byte-pair ids of whole texts, vectorised: split with numpy, encode each distinct piece once with ``tokenizers``, gather.

Byte-level BPE never merges over the pieces of its splitting pattern, so a text's ids are its pieces' ids end to end. Texts
that hold the string of an added token, which is one id, are left to the tokenizer itself.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words as W

#: Character classes of the pattern that splits text: other, letter, number, white space.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Texts with characters from here on are left to the tokenizer itself, as Unicode versions may differ on them.
FAST_LIMIT = 0x500
#: Pieces remembered at once by a Python worker; a full memory is emptied, which costs time only.
REMEMBERED = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    out = np.zeros(FAST_LIMIT, np.uint8)
    for c in range(FAST_LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return out


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start among the code points of texts that lie end to end; the pieces tile each text.

    A piece is an English contraction ending, or a run of letters, of numbers or of other signs with at most one space
    before it, or a run of white space. Of a run of white space before anything else, the last character is not part: it goes
    to the next piece if it is a space, and is a piece otherwise.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[bounds[bounds < n]] = True
    head[n] = True
    run = np.ones(n + 1, bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= head
    solid = kind != SPACE
    first = run[:n].copy()
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (points[:-1] == 32) & ~head[1:n]
    attached = first & solid & blank_before
    first[attached] = False
    at = np.flatnonzero(attached)
    first[at - 1] = True
    lone = np.flatnonzero(run[:n] & solid & ~attached & ~head[:n])
    lone = lone[kind[lone - 1] == SPACE]
    first[lone - 1] = True  # the last white space of a run, where it is no space
    mark = np.flatnonzero((points == 39) & run[:n] & ~attached)
    if len(mark):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        apart = np.concatenate([head, np.ones(3, bool)])
        same1, same2 = ~apart[mark + 1], ~apart[mark + 1] & ~apart[mark + 2]
        one, two = padded[mark + 1], padded[mark + 2]
        length = np.where(same1 & np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for pair in ("re", "ve", "ll"):
            length = np.where(same2 & (one == ord(pair[0])) & (two == ord(pair[1])), 3, length)
        hit, length = mark[length > 0], length[length > 0]
        first[hit + 1] = False
        behind = hit + length
        inner = behind[(behind < n)]
        inner = inner[(kind[inner] == LETTER) & ~head[inner]]
        first[inner] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids of texts; remembers the ids of pieces from one call to the next."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.offset, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _lookup(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        found = [self.known.get(h, -1) for h in hashes.tolist()]
        at = np.array(found, np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            coded = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], add_special_tokens=False)
            own = [c.ids for c in coded]
            length = np.array([len(x) for x in own], np.int64)
            at[new] = len(self.length) + np.arange(len(new))
            self.known.update(zip(hashes[new].tolist(), at[new].tolist(), strict=True))
            self.offset = np.concatenate([self.offset, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, np.array([i for x in own for i in x], np.uint32)])
        return at

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> list[int]:
        """Texts in which the string of an added token begins."""
        out = []
        for added in self.added:
            at = raw.find(added)
            while at >= 0:
                out.append(int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(added, int(offsets[out[-1] + 1]))
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and where each text's start (n + 1 offsets)."""
        raw = data.tobytes()
        whole = raw.decode()
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        bounds = np.searchsorted(place, offsets)
        odd = np.flatnonzero(points >= FAST_LIMIT)
        slow = np.unique(np.concatenate([np.searchsorted(bounds, odd, "right") - 1, np.array(self._with_added(raw, offsets), np.int64)]))
        starts = piece_starts(np.where(points >= FAST_LIMIT, 65, points), bounds)
        spans = np.concatenate([place[starts], [len(data)]])
        hashes = W.span_hashes(data, spans[:-1], spans[1:])
        text_of = np.searchsorted(bounds, starts, "right") - 1
        if len(slow):
            fast = ~np.isin(text_of, slow)
            begin, end, hashes, text_of = spans[:-1][fast], spans[1:][fast], hashes[fast], text_of[fast]
        else:
            begin, end = spans[:-1], spans[1:]
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        piece = self._lookup(distinct, raw, begin[where], end[where])[inverse]
        length = self.length[piece]
        total = np.cumsum(length)
        flat = self.ids[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.offset[piece] - total + length, length)]
        counts = np.bincount(text_of, length, minlength=len(offsets) - 1).astype(np.int64)
        if len(slow):
            cut = np.concatenate([[0], np.cumsum(counts)])
            parts = [flat[cut[d] : cut[d + 1]] for d in range(len(counts))]
            for d, coded in zip(slow, self.tokenizer.encode_batch_fast([raw[offsets[d] : offsets[d + 1]].decode() for d in slow], add_special_tokens=False), strict=True):
                parts[d] = np.array(coded.ids, np.uint32)
                counts[d] = len(coded.ids)
            flat = np.concatenate(parts)
        return flat, np.concatenate([[0], np.cumsum(counts)])


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, each text's range among them) over whole texts; null is empty."""
    own = encoder(path)
    for i, j, data, offsets in W.chunks(*W.text_bytes(column)):
        yield i, j, *own.encode(data, offsets)
