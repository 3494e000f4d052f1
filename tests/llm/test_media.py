"""JPEG storage: exact round trips, and a decoder test on files with other tables, components and no restarts."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from lagframe.llm import media


def padded(text):
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def test_round_trip_of_texts(spark):
    texts = [None, "", "a", "x" * 64, "x" * 65, "äöü€😀" * 50, "line\n" * 30000, "a", "".join(map(chr, range(1, 600)))]
    rows = [(i if i != 4 else None, t, "c") for i, t in enumerate(texts)]
    stored = media.store_media(spark.createDataFrame(rows, "doc_id long, text string, media string"))
    out = media.read_media(stored, payloads=True).collect()
    for (i, t, _), r in zip(rows, out, strict=True):
        own, n = padded(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload) == (i, n, len(own), bytearray(own))
        assert r.payload_sha256 == hashlib.sha256(own).hexdigest() and r.tail_crc32 == zlib.crc32(own[-64:])
        assert r.width % 8 == 0 and r.width * r.height >= len(own)
    assert out[2].media_sha256 == out[7].media_sha256 and out[2].thumbnail_hash == out[7].thumbnail_hash
    assert media.media_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_bytes_are_kept():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 70000, dtype=np.uint8)
    data[:3000] = 255
    offsets = np.array([0, 0, 1, 64, 5000, 70000])
    for head, a, b in zip(media.decode(media.encode(data, offsets)), offsets[:-1], offsets[1:], strict=True):
        assert media.payload(head)[: b - a] == data[a:b].tobytes()


def canonical(lengths):
    """Codes of symbols by length, as a JPEG table gives them."""
    code, out = 0, {}
    for n in range(1, 17):
        for s in sorted(k for k, v in lengths.items() if v == n):
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


def table(kind, lengths):
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return media._segment(0xC4, bytes([kind]) + counts + bytes(s for n in range(1, 17) for s in sorted(k for k, v in lengths.items() if v == n)))


def write_jpeg(blocks, order, parts, width, height, restart=0):
    """A plain bit-by-bit encoder of quantised blocks in scan order."""
    dc = {s: 4 for s in range(12)}
    ac = {r << 4 | s: 9 for r in range(16) for s in range(1, 11)} | {0: 2, 0xF0: 9}
    dc_code, ac_code = canonical(dc), canonical(ac)
    out, bits, before = bytearray(), "", [0] * len(parts)

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            b = int(bits[i : i + 8], 2)
            out.extend([b, 0] if b == 255 else [b])
        bits = ""

    def value(v):
        n = abs(int(v)).bit_length()
        return n, format(int(v) if v > 0 else int(v) + (1 << n) - 1, f"0{n}b") if n else ""

    for i, block in enumerate(blocks):
        mcu, c = i // len(order), order[i % len(order)]
        if restart and i and i % len(order) == 0 and mcu % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            before = [0] * len(parts)
        n, extra = value(block[0] - before[c])
        before[c] = block[0]
        bits += format(dc_code[n][0], f"0{dc_code[n][1]}b") + extra
        run = 0
        for v in block[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += format(ac_code[0xF0][0], f"0{ac_code[0xF0][1]}b")
                run -= 16
            n, extra = value(v)
            bits += format(ac_code[run << 4 | n][0], f"0{ac_code[run << 4 | n][1]}b") + extra
            run = 0
        if run:
            bits += format(ac_code[0][0], f"0{ac_code[0][1]}b")
    flush()
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts))
    scan = bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\0\x3f\0"
    head = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, b"\0" + b"\3" * 64) + media._segment(0xC0, frame) + table(0, dc) + table(0x10, ac)
    return head + (media._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + media._segment(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_decoder_on_other_files(restart):
    rng = np.random.default_rng(restart)
    files, wanted = [], []
    for parts, width, height in (([(1, 1)], 40, 24), ([(2, 2), (1, 1), (1, 1)], 50, 33), ([(1, 1)] * 3, 17, 9)):
        order = [c for c, (h, v) in enumerate(parts) for _ in range(h * v if len(parts) > 1 else 1)]
        big = max(h for h, _ in parts) * 8
        mcus = -(-width // big) * -(-height // big)
        blocks = np.where(rng.random((mcus * len(order), 64)) < 0.2, rng.integers(-200, 201, (mcus * len(order), 64)), 0)
        blocks[:, 0] = rng.integers(-300, 300, len(blocks))
        files.append(write_jpeg(blocks, order, parts, width, height, restart))
        wanted.append((blocks, width, height))
    for head, (blocks, width, height) in zip(media.decode(files), wanted, strict=True):
        assert np.array_equal(head["blocks"], blocks)
        light = media.thumbnail(head)
        assert light.shape == (-(-height // 8), -(-width // 8))
        assert light[0, 0] == np.clip(blocks[0, 0] * 3 // 8 + 128, 0, 255)


def test_other_bytes_give_nulls(spark):
    rows = [(1, None), (2, b""), (3, b"no image"), (4, b"\xff\xd8\xff\xc2\x00\x04\x00\x00")]
    out = media.read_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.media_bytes, r.width, r.payload_sha256) for r in out] == [(1, None, None, None), (2, 0, None, None), (3, 8, None, None), (4, 8, None, None)]
