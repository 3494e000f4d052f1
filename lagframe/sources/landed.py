"""Checks of whole landed files of any length: digests, and JSON validity with the place of an error.

A file of up to ``WHOLE`` bytes is one value of a row, read by Spark from any store. A longer one is never a value: its task
streams it in pieces from the store that its URI names (local, HDFS, S3 or GCS).
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that may be one value, and of a piece of a longer one.
WHOLE, PIECE = 8 << 20, 1 << 20

_SPACE = re.compile(r"[ \t\r\n]*+")
_TEXT = re.compile(r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+')
_WORD = re.compile(r"[-+.0-9A-Za-z]*+")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")


class JsonText:
    """Whether the pieces fed to it are one JSON value, with the line and column (from 1, in characters) of the first that can't be.

    Memory is bounded by a piece, a number and the depth of nesting. ``NaN`` and infinities are values; keys may repeat.
    """

    def __init__(self) -> None:
        self.open, self.want, self.quoted, self.rest = [], "value", False, ""
        self.line, self.column, self.error = 1, 1, None

    def _after_value(self) -> None:
        self.want = "comma or close" if self.open else "end"

    def _step(self, text: str, p: int, last: bool) -> int | None:
        """Where the token at ``p`` ends; ``p`` if it may go on in the next piece; None if there can be none."""
        if self.quoted:
            end = _TEXT.match(text, p).end()
            if end < len(text) and text[end] == '"':
                self.quoted = False
                if self.want == "key":
                    self.want = "colon"
                else:
                    self._after_value()
                return end + 1
            cut = end == len(text) or (text[end] == "\\" and len(text) - end < 6)
            return end if cut or end > p else None
        c, want = text[p], self.want
        if c in "}]":
            if want not in ("comma or close", "first value", "first key") or not self.open or self.open[-1] + c not in ("{}", "[]"):
                return None
            self.open.pop()
            self._after_value()
        elif c == ",":
            if want != "comma or close":
                return None
            self.want = "key" if self.open[-1] == "{" else "value"
        elif c == ":":
            if want != "colon":
                return None
            self.want = "value"
        elif c == '"':
            if want not in ("value", "first value", "key", "first key"):
                return None
            self.quoted, self.want = True, want.removeprefix("first ")
        elif want not in ("value", "first value"):
            return None
        elif c in "{[":
            self.open.append(c)
            self.want = "first key" if c == "{" else "first value"
        else:
            end = _WORD.match(text, p).end()
            if end == len(text) and not last:
                return p
            if not _SCALAR.fullmatch(text, p, end):
                return None
            self._after_value()
            return end
        return p + 1

    def feed(self, piece: str, last: bool = False) -> bool:
        """Take a piece in; False once the text can't be JSON."""
        if self.error:
            return False
        text, p, bad = self.rest + piece, 0, False
        while True:
            p = p if self.quoted else _SPACE.match(text, p).end()
            if p == len(text):
                bad = last and (self.quoted or self.want != "end")
                break
            end = self._step(text, p, last)
            if end is None or (end == p and last):
                bad = True
                break
            if end == p:
                break
            p = end
        lines = text.count("\n", 0, p)
        self.column = p - text.rfind("\n", 0, p) if lines else self.column + p
        self.line, self.rest = self.line + lines, text[p:]
        if bad:
            self.error = "string not closed or not allowed" if self.quoted else f"{self.want.replace('first ', 'close or ')} expected"
        return not bad


def _pieces(uri: str, content: pa.BinaryScalar | None, unzip: bool) -> Iterator[bytes]:
    if content is not None and content.is_valid:
        raw = pa.BufferReader(content.as_buffer())
    else:
        store, name = pyarrow.fs.FileSystem.from_uri(uri)
        raw = store.open_input_stream(name, compression=None)
    with pa.CompressedInputStream(raw, "gzip") if unzip else raw as stream:
        while piece := stream.read(PIECE):
            yield piece


def _judge(uri: str, content: pa.BinaryScalar | None) -> JsonText:
    text, decode = JsonText(), codecs.getincrementaldecoder("utf-8")()
    try:
        for piece in _pieces(uri, content, uri.endswith(".gz")):
            if not text.feed(decode.decode(piece)):
                return text
        text.feed(decode.decode(b"", True), last=True)
    except UnicodeDecodeError:
        text.error = text.error or "not UTF-8"
    except (OSError, EOFError) as e:
        if not uri.endswith(".gz"):
            raise  # a file that can't be read is the store's fault, and the task is tried again
        text.error = f"not gzip: {e}"
    return text


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length", "content")


def validate_json_files(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """``file``, ``valid``, and ``error``, ``line``, ``column`` of the first character that can't be (null where valid): whether
    each file is one JSON value in UTF-8, ``.gz`` files unpacked. A byte order mark is an error; of a file that isn't UTF-8 or gzip the
    place is that of the piece. Spark lists no files of 0 bytes, so those have no row."""
    form = pa.schema([("file", pa.string()), ("valid", pa.bool_()), ("error", pa.string()), ("line", pa.int64()), ("column", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                text = _judge(uri, content)
                place = (text.error, text.line, text.column) if text.error else (None, None, None)
                yield pa.RecordBatch.from_pylist([dict(zip(form.names, (uri, not text.error, *place), strict=True))], form)

    files = _files(spark, path)
    short = files.where(F.col("length") <= whole).select("file", "content")
    long = files.where(F.col("length") > whole).select("file", F.lit(None).cast("binary").alias("content"))
    return short.union(long).mapInArrow(run, "file string, valid boolean, error string, line long, column long")


def md5_of_files(spark: SparkSession, path: str | list[str], whole: int = WHOLE) -> DataFrame:
    """``file``, ``md5`` (lowercase hex) of each file's bytes as they are stored. Spark lists no files of 0 bytes, so those have no row."""

    def run(batches):
        for batch in batches:
            uris, sums = batch.column("file").to_pylist(), []
            for uri in uris:
                digest = hashlib.md5()
                for piece in _pieces(uri, None, False):
                    digest.update(piece)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(sums, pa.string())], ["file", "md5"])

    files = _files(spark, path)
    short = files.where(F.col("length") <= whole).select("file", F.md5("content").alias("md5"))
    return short.union(files.where(F.col("length") > whole).select("file").mapInArrow(run, "file string, md5 string"))
