"""Media columns: baseline JPEG. Payloads are kept losslessly as quantised coefficients; features come from DC-only thumbnails.

JPEG's lossless unit is the quantised DCT coefficient, not the sample. One 8 x 8 block keeps 64 payload bytes as its 64
coefficients in zigzag order: byte b is the coefficient of magnitude category 8 whose eight value bits are b (b below 128
stands for b - 255). Every coefficient takes one code bit and eight value bits, a block 72 bytes; each block is a restart
interval of its own. The files are ordinary baseline JPEG; a comment segment keeps the payload's length.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

UNIT = 64
#: Step of the DC coefficient; 4 spreads the stored bytes over all luminances of the thumbnail.
DC_STEP = 4
_MARK = b"payload:"


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0" + bytes([DC_STEP]) + b"\1" * 63)
_CODES = _segment(0xC4, b"\x00" + bytes([1] + [0] * 15) + b"\x08") + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x08") + _segment(0xDD, b"\0\1")
_SCAN = _segment(0xDA, b"\1\1\0\0\x3f\0")


def shape(blocks: int) -> tuple[int, int]:
    """Width and height in blocks of a near-square grid that holds ``blocks`` blocks."""
    wide = int(np.ceil(np.sqrt(blocks)))
    if wide > 8191:
        raise ValueError("a payload of over 4 GB doesn't fit into one JPEG")
    return wide, -(-blocks // wide)


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """JPEG files of the payloads data[offsets[i]:offsets[i + 1]], each padded with zeros to a positive multiple of 64."""
    sizes = np.diff(offsets)
    blocks = np.maximum(-(-sizes // UNIT), 1)
    shapes = [shape(int(b)) for b in blocks]
    total = np.array([w * h for w, h in shapes], np.int64)
    base = np.concatenate([[0], np.cumsum(total)])
    flat = np.zeros(int(base[-1]) * UNIT, np.uint8)
    for d, n in enumerate(sizes):
        flat[base[d] * UNIT : base[d] * UNIT + n] = data[offsets[d] : offsets[d + 1]]
    out = []
    piece = 1 << 15
    coded = np.empty((int(base[-1]), 72), np.uint8)
    for a in range(0, len(coded), piece):
        part = flat[a * UNIT : (a + piece) * UNIT].reshape(-1, 1)
        bits = np.zeros((len(part), 9), np.uint8)
        bits[:, 1:] = np.unpackbits(part, axis=1)
        coded[a : a + piece] = np.packbits(bits.reshape(-1, 576), axis=1)
    stuffed = np.add.reduceat((coded == 0xFF).sum(axis=1), base[:-1]) if len(total) else []
    for d, (w, h) in enumerate(shapes):
        n = int(total[d])
        rows = np.empty((n, 74), np.uint8)
        rows[:, :72] = coded[base[d] : base[d + 1]]
        rows[:, 72] = 0xFF
        rows[:, 73] = 0xD0 + np.arange(n) % 8
        scan = rows.tobytes()[:-2]
        if stuffed[d]:
            at = np.flatnonzero(np.frombuffer(scan, np.uint8) == 0xFF)
            at = at[at % 74 != 72] + 1
            scan = np.insert(np.frombuffer(scan, np.uint8), at, 0).tobytes()
        frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * h, 8 * w, 1) + b"\1\x11\0")
        out.append(b"\xff\xd8" + _segment(0xFE, _MARK + struct.pack(">Q", int(sizes[d]))) + _TABLES + frame + _CODES + _SCAN + scan + b"\xff\xd9")
    return out


@functools.lru_cache(256)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits: code length * 256 + symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    code = k = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse(raw: bytes) -> dict:
    """Frame, tables and the place of the scan of a baseline JPEG with one scan; ValueError for anything else."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, out = 2, {"quant": {}, "codes": {}, "restart": 0, "n_bytes": None}
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1)
                out["quant"][body[k] & 15] = values.astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                out["codes"][body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xC0:
            precision, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not out["height"] or not out["width"]:
                raise ValueError("8-bit samples and a stated size are needed")
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(_MARK):
            out["n_bytes"] = struct.unpack(">Q", body[len(_MARK) :])[0]
        elif marker == 0xDA:
            if "parts" not in out or body[0] != len(out["parts"]):
                raise ValueError("one scan of all components is read")
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            out["scan"] = at
            one = len(out["parts"]) == 1
            hs, vs = max(p[1] for p in out["parts"]), max(p[2] for p in out["parts"])
            across, down = (-(-out["width"] // 8), -(-out["height"] // 8)) if one else (-(-out["width"] // (8 * hs)), -(-out["height"] // (8 * vs)))
            out["grid"] = (across, down)
            order = []
            for c, (i, h, v, q) in enumerate(out["parts"]):
                dc, ac = out["codes"][tables[i] >> 4], out["codes"][0x10 | tables[i] & 15]
                order += [(c, dc, ac, out["quant"][q])] * (1 if one else h * v)
            out["order"] = order
            return out
    raise ValueError("there is no scan")


def decode(files: list[bytes]) -> list[dict | None]:
    """Headers with ``blocks``, the quantised coefficients (blocks x 64, zigzag, scan order); None for what can't be read.

    All restart intervals of all files are Huffman-decoded in step, one symbol each at a time.
    """
    heads: list[dict | None] = []
    clean, lanes, tables, books = [], [], [], {}
    place = base = 0
    for f, raw in enumerate(files):
        try:
            head = parse(raw)
        except (ValueError, KeyError, IndexError, struct.error):
            heads.append(None)
            continue
        heads.append(head)
        scan = np.frombuffer(raw, np.uint8)[head["scan"] :]
        ff = np.flatnonzero(scan[:-1] == 0xFF)
        after = scan[ff + 1]
        stop = ff[(after != 0) & ((after & 0xF8) != 0xD0)]
        end = int(stop[0]) if len(stop) else len(scan)
        inside = ff < end
        restarts = ff[inside & ((after & 0xF8) == 0xD0)]
        keep = np.ones(end, bool)
        keep[ff[inside & (after == 0)] + 1] = False
        keep[restarts] = keep[restarts + 1] = False
        at = np.concatenate([[0], np.cumsum(keep)])
        mcus, step = head["grid"][0] * head["grid"][1], head["restart"] or head["grid"][0] * head["grid"][1]
        n = -(-mcus // step)
        begin = np.concatenate([[0], at[restarts]])[:n]
        per = len(head["order"])
        if len(begin) < n:
            heads[-1] = None
            continue
        head["n_blocks"], head["base"] = mcus * per, base
        book = []
        for _, dc, ac, _ in head["order"]:
            for pair in (dc, ac):
                if pair not in books:
                    books[pair] = len(tables)
                    tables.append(_lookup(*pair))
                book.append(books[pair])
        count = np.full(n, step * per, np.int64)
        count[-1] = (mcus - step * (n - 1)) * per
        lanes.append((f, begin + place, count, base + np.arange(n) * step * per, per, tuple(book), tuple(c for c, *_ in head["order"])))
        clean.append(scan[:end][keep])
        place += int(keep.sum())
        base += mcus * per
    coefficients = _huffman(np.concatenate([*clean, np.zeros(16, np.uint8)]), lanes, np.stack(tables) if tables else None, base)
    for f, head in enumerate(heads):
        if head is not None:
            head["blocks"] = coefficients[head["base"] : head["base"] + head["n_blocks"]]
    return heads


def _huffman(data: np.ndarray, lanes: list, tables: np.ndarray | None, n_blocks: int) -> np.ndarray:
    out = np.zeros((n_blocks + 1, 64), np.int16)
    if not lanes:
        return out
    kinds = {k: i for i, k in enumerate(dict.fromkeys((x[5], x[6]) for x in lanes))}
    per_kind = max(len(b) for b, _ in kinds)
    book = np.zeros((len(kinds), per_kind), np.int64)
    part = np.zeros((len(kinds), per_kind), np.int64)
    for (b, c), i in kinds.items():
        book[i, : len(b)] = b
        part[i, : len(c)] = c
    kind = np.concatenate([np.full(len(x[1]), kinds[x[5], x[6]]) for x in lanes])
    per = np.concatenate([np.full(len(x[1]), x[4]) for x in lanes])
    bit = np.concatenate([x[1] for x in lanes]) * 8
    block = np.concatenate([x[3] for x in lanes])
    left = np.concatenate([x[2] for x in lanes])
    lane = np.arange(len(bit))
    turn, k = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    before = np.zeros((len(bit), int(part.max()) + 1), np.int64)
    words = np.ndarray((len(data) - 8,), ">u8", data.tobytes(), strides=(1,))
    last, flat = len(words) - 1, tables.reshape(-1)
    same = len(kinds) == 1 and per_kind == 2
    while len(bit):
        at_dc = k == 0
        window = words[np.minimum(bit >> 3, last)].astype(np.uint64) << (bit & 7).astype(np.uint64)
        table = np.where(at_dc, book[0, 0], book[0, 1]) if same else book[kind, 2 * turn + ~at_dc]
        found = flat[(table << 16) + (window >> np.uint64(48)).astype(np.int64)]
        length, size = (found >> 8).astype(np.int64), (found & 15).astype(np.int64)
        run = np.where(at_dc, 0, (found >> 4) & 15).astype(np.int64)
        bits = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)
        value[size == 0] = 0
        bit += length + size
        if same:
            value = np.where(at_dc, value + before[:, 0], value)
            before[:, 0] = np.where(at_dc, value, before[:, 0])
        else:
            c = part[kind, turn]
            rows = np.arange(len(c))
            value = np.where(at_dc, value + before[rows, c], value)
            before[rows[at_dc], c[at_dc]] = value[at_dc]
        k += run
        ends = ~at_dc & (size == 0) & (run < 15)
        puts = (k < 64) & ((size > 0) | at_dc) & (length > 0)
        out[np.where(puts, block, n_blocks), np.minimum(k, 63)] = value
        k += 1
        k[ends] = 64
        k[length == 0] = 64
        full = k >= 64
        if full.any():
            block += full
            left -= full
            k[full] = 0
            turn = np.where(full, (turn + 1) % per, turn)
            if (left == 0).any():
                go = left > 0
                bit, block, left, lane, turn, k, before, kind, per = (x[go] for x in (bit, block, left, lane, turn, k, before, kind, per))
    return out


def payload(head: dict) -> bytes:
    """The stored payload with its padding, from the coefficients."""
    n = max(UNIT, -(-head["n_bytes"] // UNIT) * UNIT)
    values = head["blocks"].reshape(-1)[:n]
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


def thumbnail(head: dict) -> np.ndarray:
    """Luminance of each block of the first component, from its DC coefficient alone."""
    own = np.array([c == 0 for c, *_ in head["order"]])
    across, down = head["grid"]
    step = int(head["order"][0][3][0])
    dc = head["blocks"][:, 0].reshape(down * across, len(own))[:, own].astype(np.int64)
    h, v = (1, 1) if len(head["parts"]) == 1 else head["parts"][0][1:3]
    light = np.clip(dc * step // 8 + 128, 0, 255).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    wide = max(p[1] for p in head["parts"]) if len(head["parts"]) > 1 else 1
    high = max(p[2] for p in head["parts"]) if len(head["parts"]) > 1 else 1
    return light[: -(-head["height"] * v // (8 * high)), : -(-head["width"] * h // (8 * wide))].astype(np.uint8)


def thumbnail_hash(light: np.ndarray) -> str:
    """64 bits: which of 8 x 8 areas are lighter than their mean."""
    total = np.zeros((light.shape[0] + 1, light.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(light, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    edge = [(np.arange(8) * n // 8, np.maximum(np.arange(1, 9) * n // 8, np.arange(8) * n // 8 + 1)) for n in light.shape]
    (a, b), (c, d) = edge
    area = (total[np.ix_(b, d)] - total[np.ix_(a, d)] - total[np.ix_(b, c)] + total[np.ix_(a, c)]) / np.outer(b - a, d - c)
    return np.packbits(area > area.mean()).tobytes().hex()


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``media``: each whole text's UTF-8 bytes as a baseline JPEG. A null text is empty.

    Repeated rows and null ids are kept; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets).astype(np.int64)), pa.array(encode(data, offsets), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the stored files back: size, hash and DC-only thumbnail of each, and digests of the payload that it keeps.

    Columns: ``doc_id``, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the payload's last 64 bytes),
    ``media_bytes``, ``media_sha256``, ``width``, ``height``, ``thumbnail_hash``, and with ``payloads`` also ``payload`` and
    ``thumbnail``. For null media, and for files that are no baseline JPEG, everything read from the file is null; files
    without a payload have null payload columns. Repeated rows are kept; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumbnail_hash"] + ["payload", "thumbnail"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary(), pa.binary()] * payloads

    def run(batches):
        for batch in batches:
            ids, files = batch.column("doc_id").to_pylist(), batch.column("media")
            size, at = [len(x.as_buffer()) if x.is_valid else 0 for x in files], 0
            while at < len(ids):
                to, total = at, 0
                while to < len(ids) and (to == at or total + size[to] <= W.CHUNK_BYTES):
                    total += size[to]
                    to += 1
                raws = [x.as_py() for x in files.slice(at, to - at)]
                rows = []
                for i, raw, head in zip(ids[at:to], raws, decode([r or b"" for r in raws]), strict=True):
                    row = [i, *[None] * (len(names) - 1)]
                    if raw is not None:
                        row[5:7] = len(raw), hashlib.sha256(raw).hexdigest()
                    if head is not None:
                        light = thumbnail(head)
                        row[7:10] = head["width"], head["height"], thumbnail_hash(light)
                        own = payload(head) if head["n_bytes"] is not None else None
                        if own is not None:
                            row[1:5] = head["n_bytes"], len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-UNIT:])
                        if payloads:
                            row[10:12] = own, light.tobytes()
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                at = to

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, thumbnail_hash string"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, schema + ", payload binary, thumbnail binary" * payloads)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store, read back and describe every text: the digest columns, and ``feature``: pixel size and thumbnail hash.

    A null text is empty; repeated rows and null ids are returned as they are; columns other than ``doc_id`` and ``text`` are ignored.
    """
    read = read_media(store_media(docs))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumbnail_hash")).alias("feature"))
