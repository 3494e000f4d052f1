"""Whole texts as flat numpy arrays: bytes, words, word hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. All of those bytes are ASCII, so byte runs and character runs
are the same words in UTF-8. Hashes are 64 bits wide; two different words or shingles collide with chance 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in pieces of about so many bytes (a longer text is a piece of its own), which bounds a task's memory.
CHUNK_BYTES = 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_M, _M_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each text starts (n + 1 offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    size, n, i = size or CHUNK_BYTES, len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's range among them (n + 1 offsets)."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with a space behind each, and where each word starts there (n + 1 offsets)."""
    at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = np.full(at[-1], 32, np.uint8)
    solid = np.ones(len(out), bool)
    solid[at[1:] - 1] = False
    out[solid] = data[~((data == 32) | ((data >= 9) & (data <= 13)))]
    return out, at


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (of the flat array; runs over a text's end are the caller's to skip)."""
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        out = mix64(words[:n] + np.uint64(k))
        for i in range(1, k):
            out = mix64(out * np.uint64(31) + words[i : n + i])
    return out


def rolling_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """As :func:`gram_hashes` at a cost that doesn't depend on ``k``: a polynomial over mixed word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * power[: len(words)], out=total[1:])
        return mix64((total[k:] - total[:n]) * inverse[:n] + np.uint64(k))


def inner_starts(ranges: np.ndarray, k: int) -> np.ndarray:
    """Flat start positions of the runs of ``k`` words that lie within one text."""
    n = int(ranges[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for d in range(len(ranges) - 1):
        a = max(int(ranges[d]), int(ranges[d + 1]) - k + 1)
        if a < n:
            ok[a : min(n, int(ranges[d + 1]))] = False
    return np.flatnonzero(ok)
