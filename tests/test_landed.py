"""Checks of landed files: JSON in pieces against the standard parser, places of errors, digests of long files."""

import gzip
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagframe.plans.queries import QUERIES, SQL
from lagframe.sources import landed, readers

from .compare import DATA, database, rows

VALUES = st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=3), v, max_size=4), max_leaves=12)


def judged(text, size):
    j = landed.JsonText()
    for i in range(0, len(text), size):
        j.feed(text[i : i + size])
    j.feed("", last=True)
    return j


def parses(text):
    try:
        json.loads(text)
    except json.JSONDecodeError:
        return False
    return True


@settings(max_examples=400, deadline=None)
@given(VALUES, st.booleans(), st.sampled_from([None, 1, 2]), st.integers(1, 9), st.data())
def test_agrees_with_the_standard_parser(value, ascii_only, indent, size, data):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    for _ in range(data.draw(st.integers(0, 2))):  # faults
        a = data.draw(st.integers(0, len(text)))
        text = text[:a] + data.draw(st.sampled_from(["", *'{}[]",:\\u01-.eE \n', "true", "NaN", "\x01", "﻿", "-Infinity"])) + text[a + data.draw(st.integers(0, 1)) :]
    one, whole = judged(text, size), judged(text, len(text) + 1)
    assert (one.error is None) == parses(text), text
    assert (one.error, one.line, one.column) == (whole.error, whole.line, whole.column) or one.error is None


@pytest.mark.parametrize(
    ("text", "place"),
    [("", (1, 1)), (" \n", (2, 1)), ("[1,\n 2,]", (2, 4)), ('{"a": 01}', (1, 7)), ('{"a"\n\n 1}', (3, 2)), ('["a\nb"]', (1, 4)), ('["a', (1, 4)), ('[1] "', (1, 5)), ("[[1]", (1, 5)), ('["\\u12x4"]', (1, 3)), ("nul", (1, 1)), ('{"a":1,}', (1, 8)), ("]", (1, 1)), ("[}", (1, 2)), ("﻿1", (1, 1))],
)
def test_place_of_an_error(text, place):
    for size in (1, 2, 100):
        j = judged(text, size)
        assert j.error and (j.line, j.column) == place


def test_deep_and_long_values():
    assert judged("[" * 50_000 + "]" * 50_000, 777).error is None
    assert judged('["' + "x" * 300_000 + '"]', 1000).error is None


@pytest.mark.parametrize("whole", [landed.WHOLE, 10])
def test_files_whole_and_in_pieces(spark, tmp_path, whole):
    good = json.dumps([{"a": i, "b": "é" * i} for i in range(200)], ensure_ascii=False).encode()
    files = {"good.json": good, "empty.json": b"", "na me+x%.json": good, "more.json": good + b"\n]", "latin.json": b'["\xe9"]  ' * 3, "good.json.gz": gzip.compress(good) + gzip.compress(b"  "), "cut.json.gz": gzip.compress(good)[:-20]}
    (tmp_path / "in").mkdir()
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    out = {r.file.rsplit("/", 1)[1]: r for r in landed.validate_json_files(spark, f"{tmp_path}/in", whole).collect()}
    assert {n for n, r in out.items() if r.valid} == {"good.json", "na%20me+x%25.json", "good.json.gz"} and len(out) == len(files) - 1  # Spark lists no empty files
    assert (out["more.json"].error, out["more.json"].line, out["more.json"].column) == ("end expected", 2, 1)
    assert out["latin.json"].error == "not UTF-8" and out["cut.json.gz"].error and out["good.json"].error is None
    (tmp_path / "sums").mkdir()
    (tmp_path / "sums" / "all.txt").write_text("".join(f"MD5({n})= {hashlib.md5(c).hexdigest()}\n" for n, c in files.items() if n != "more.json"))
    (tmp_path / "sums" / "more.json.md5").write_text("0" * 32)
    (tmp_path / "sums" / "gone.json.md5").write_text("1" * 32)
    got = {r.name: r.ok for r in readers.verify_checksums(spark, f"{tmp_path}/in", f"{tmp_path}/sums", whole).collect()}
    assert got == {n: n not in ("more.json", "empty.json") for n in files} | {"gone.json": False}


@pytest.mark.parametrize("name", ["json_errors", "json_valid", "checksum"])
def test_queries(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(database().sql(SQL[name]).df())
