"""Conversation structure repair: weighted CYK parsing of turn spans, with keep, rerole, delete and insert as weighted rules.

Repaired role initials must read ``(s?(ua)+)?``. The grammar's nonterminals are the spans [p q] that lead the four states of that
form from p to q, so it is in Chomsky normal form with the binary rules [p q] -> [p r] [r q], and a cell holds the least
(cost, audit) of a span. Such rules hold at every split of a span alike: one split a span is enough, and n turns take n - 1
combinations, bottom-up by span length 1, 2, 4, ..., instead of n ** 3. Two audits of one span and cost never are each other's
prefixes (they have a letter for each turn, and insertions cost), so the least audits of two neighbours make the least of both.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and of each truncated turn that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, a system turn, a user turn, an assistant turn; what a turn with an initial leads to; where a conversation may end.
MOVES = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
CELLS = [(p, q) for p in range(4) for q in range(4)]

_BLANKS = r"\x20\x09-\x0D"

Cells = tuple[tuple[int, str] | None, ...]


def _least(edits: list[tuple[int, int, int, str]]) -> Cells:
    """Cells of (from, to, cost, audit) edits."""
    out: list[tuple[int, str] | None] = [None] * 16
    for p, q, cost, audit in edits:
        now = out[4 * p + q]
        out[4 * p + q] = (cost, audit) if now is None or (cost, audit) < now else now
    return tuple(out)


def combine(left: Cells, right: Cells) -> Cells:
    """The binary rules: cells of two neighbouring spans together."""
    out: list[tuple[int, str] | None] = []
    for p in range(0, 16, 4):
        for q in range(4):
            best = None
            for r in range(4):
                a, b = left[p + r], right[4 * r + q]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                    best = (cost, a[1] + b[1])
            out.append(best)
    return tuple(out)


_NOTHING = _least([(p, p, 0, "") for p in range(4)])


@lru_cache(maxsize=1)
def insertions() -> Cells:
    """The insertion closure: cells of an empty span."""
    one = _least([(p, p, 0, "") for p in range(4)] + [(p, q, INSERT, "I") for (c, p), q in MOVES.items() if c in NAMES])
    out = _NOTHING
    while (more := combine(out, one)) != out:
        out = more
    return out


@lru_cache(maxsize=4096)
def turn_cells(initial: str, truncated: bool) -> Cells:
    """Cells of one turn that is neither blank nor a duplicate."""
    extra = TRUNCATED if truncated else 0
    edits = [(p, p, DELETE, "D") for p in range(4)]
    edits += [(p, q, extra, "K") for (c, p), q in MOVES.items() if c == initial]
    edits += [(p, q, REROLE + extra, "R") for (c, p), q in MOVES.items() if c in NAMES]
    return combine(combine(insertions(), _least(edits)), insertions())


@lru_cache(maxsize=64)
def deleted_cells(turns: int) -> Cells:
    """Cells of turns that must all be deleted."""
    edits = _least([(p, p, DELETE * turns, "D" * turns) for p in range(4)])
    return combine(combine(insertions(), edits), insertions())


_SPAN = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, first_turn long, high long, turns long, costs array<long>, audits array<string>"
_FIELDS = [part.split()[0] for part in _SPAN.split(", ")]


class _Span:
    """Neighbouring turns of one conversation: counts that add up, its ends, and its cells."""

    __slots__ = ("blank", "cells", "duplicate", "first", "first_turn", "high", "illegal", "last", "low", "n", "truncated", "turns")

    def __init__(self, n, blank, duplicate, truncated, illegal, first, last, low, first_turn, high, turns, cells):
        self.n, self.blank, self.duplicate, self.truncated, self.illegal = n, blank, duplicate, truncated, illegal
        self.first, self.last, self.low, self.first_turn, self.high, self.turns, self.cells = first, last, low, first_turn, high, turns, cells

    def then(self, o: _Span) -> _Span:
        if not self.n or not o.n:
            return self if self.n else o
        illegal = self.illegal + o.illegal + (self.last + o.first not in ("su", "ua", "au"))
        turns = self.turns + o.turns - (self.high is not None and self.high == o.first_turn)
        low = self.low if self.low is not None else o.low
        high = o.high if o.high is not None else self.high
        return _Span(self.n + o.n, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, illegal, self.first, o.last, low, self.first_turn, high, turns, combine(self.cells, o.cells))

    def row(self) -> list:
        return [self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.first_turn, self.high, self.turns, [c and c[0] for c in self.cells], [c and c[1] for c in self.cells]]


_EMPTY = (0, 0, 0, 0, 0, "", "", None, None, None, 0)


def _turn(initial: str, turn: int | None, blank: bool, duplicate: bool, truncated: bool) -> _Span:
    gone = blank or duplicate
    cells = deleted_cells(1) if gone else turn_cells(initial, truncated)
    return _Span(1, int(blank), int(duplicate and not blank), int(truncated and not gone), 0, initial, initial, turn, turn, turn, int(turn is not None), cells)


def _repeats(initial: str, turn: int | None, blank: bool, m: int) -> _Span:
    """``m`` further copies of one turn."""
    return _Span(m, m * blank, m * (not blank), 0, (m - 1), initial, initial, turn, turn, turn, int(turn is not None), deleted_cells(m))


def _push(stack: list[tuple[int, _Span]], span: _Span) -> None:
    """Add a span; equally long neighbours are combined, so that the stack has a span for each power of two at most."""
    size = 1
    while stack and stack[-1][0] <= size:
        before, left = stack.pop()
        size, span = before + size, left.then(span)
    stack.append((size, span))


def _fold(stack: list[tuple[int, _Span]]) -> _Span | None:
    out = None
    for _, span in reversed(stack):
        out = span if out is None else span.then(out)
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, ``copies`` of conversations damaged by the crc32 of ``conv_id:turn`` modulo 20: 0 drops
    a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's. A null is one blank, in the hashed text too."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("fault", F.crc32(key.cast("binary")) % 20)
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _prepared(rows: DataFrame) -> DataFrame:
    copies: Column = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    texts = [F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts, F.greatest(copies, F.lit(0)).alias("copies")).withColumn("digest", F.md5("text"))


ORDER = ("turn", "role", "digest")


def parse(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` of each conversation of
    ``rows(conv_id, turn, role, text)`` and, if there, ``copies`` (0: the row isn't there, but its conversation is).

    Turns are in order of ``turn`` (nulls first), ``role`` and the MD5 of ``text``. Null roles and texts are one blank; null ids are
    one conversation; equal rows each count, later ones as duplicates; a role without a letter can't be kept; other columns are ignored. Costs and edits are those of the
    module's constants; of equally cheap repairs the one with the least audit counts.

    Rows travel without texts, equal ones as one with their number, sorted by conversation and turn over ranges, so that a
    conversation of any share of the rows is parsed in many tasks: one row a conversation and range comes together at the end.
    """
    own = _prepared(rows).withColumn("blank", ~F.col("text").rlike(f"[^{_BLANKS}]")).withColumn("cut", ~F.col("text").rlike(rf"[.!?][{_BLANKS}]*\z"))
    light = own.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("m"))
    first = light.where("m > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.turn").alias("t"))
    known = light.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    known = known.select("conv_id", *ORDER, "blank", "cut", "m", (~F.col("turn").eqNullSafe(F.col("t"))).alias("seen"))
    dealt = known.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    names = ["conv_id", "at", *_FIELDS]

    def run(batches):
        key, start, stack, out = (), None, [], []

        def close():
            if key:
                out.append([key[0], start, *(_fold(stack) or _Span(*_EMPTY, _NOTHING)).row()])

        for batch in batches:
            for conv, turn, role, digest, blank, cut, m, seen in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if key != (conv,):
                    close()
                    key, start, stack = (conv,), {"turn": turn, "role": role, "digest": digest}, []
                if m:
                    _push(stack, _turn(role[:1], turn, blank, seen, cut))
                if m > 1:
                    _push(stack, _repeats(role[:1], turn, blank, m - 1))
            if len(out) > 512:
                yield _batch(out, names, _PARTS)
                out = []
        close()
        yield _batch(out, names, _PARTS)

    parts = dealt.mapInArrow(run, f"conv_id long, at struct<turn: long, role: string, digest: string>, {_SPAN}")
    whole = parts.groupBy("conv_id").agg(F.collect_list(F.struct("at", *_FIELDS)).alias("parts"))  # at most a row a range

    def finish(batches):
        for batch in batches:
            out = []
            for conv, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = []
                for x in sorted(held, key=lambda x: (x["at"]["turn"] is not None, x["at"]["turn"] or 0, x["at"]["role"], x["at"]["digest"])):
                    cells = tuple(None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True))
                    spans.append((1, _Span(*[x[f] for f in _FIELDS[:-2]], cells)))
                s = _fold(spans)
                cost, audit = min(c for c in (s.cells[q] for q in ENDS) if c is not None)
                gaps = 0 if s.low is None else s.high - s.low + 1 - s.turns
                out.append([conv, gaps, s.blank, s.duplicate, s.truncated, s.illegal, cost, audit])
            yield _batch(out, list(_PARSED.names), _PARSED)

    return whole.mapInArrow(finish, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_PARSED = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_PARTS = pa.schema(
    [("conv_id", pa.int64()), ("at", pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string())]))]
    + [(c, pa.string() if c in ("first", "last") else pa.int64()) for c in _FIELDS[:-2]]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _batch(rows: list[list], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names, strict=True)], schema=schema)


def _edited(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """Each conversation's audit (``kind`` 0, in ``text``) before its turns, which stream by in order: only the audit is held."""
    own = _prepared(rows).where("copies > 0").select("conv_id", F.lit(1).alias("kind"), *ORDER, "text", "copies")
    head = parsed.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    return head.union(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)


def _replay(batches):
    """(conversation, role, text) of the repaired turns, and (conversation, None, None) behind the last of each."""
    audit, at, state, conv = "", 0, 0, None
    begun = False

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial = "a" if state == 2 else "u"
            at, state = at + 1, MOVES[initial, state]
            yield conv, NAMES[initial], ""

    for batch in batches:
        ids, kinds, roles, texts, copies = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies"))
        for i, kind in enumerate(kinds):
            if kind == 0:
                if begun:
                    yield from inserted()
                    yield conv, None, None
                begun, conv, audit, at, state = True, ids[i], texts[i], 0, 0
                continue
            for _ in range(copies[i]):
                yield from inserted()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                initial = roles[i][:1] if edit == "K" else "a" if state == 2 else "u"
                state = MOVES[initial, state]
                yield conv, roles[i] if edit == "K" else NAMES[initial], texts[i]
    if begun:
        yield from inserted()
        yield conv, None, None


def repaired_turns(rows: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """``conv_id``, ``position`` (from 0), ``role``, ``text`` of the repaired conversations; see :func:`parse`."""

    def run(batches):
        position, out = 0, []
        for conv, role, text in _replay(batches):
            if role is None:
                position = 0
                continue
            out.append([conv, position, role, text])
            position += 1
            if len(out) >= 4096:
                yield _batch(out, schema.names, schema)
                out = []
        yield _batch(out, schema.names, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _edited(rows, parse(rows) if parsed is None else parsed).mapInArrow(run, "conv_id long, position long, role string, text string")


def repaired_digests(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """``conv_id``, ``repaired_sha256``: of the repaired turns as ``role:text`` lines. A hash runs over its conversation in order, so
    one task reads a conversation's turns; it holds none but the one in hand."""

    def run(batches):
        digest, begun, out = hashlib.sha256(), False, []
        for conv, role, text in _replay(batches):
            if role is None:
                out.append([conv, digest.hexdigest()])
                digest, begun = hashlib.sha256(), False
                continue
            digest.update((b"\n" if begun else b"") + f"{role}:{text}".encode())
            begun = True
        yield _batch(out, schema.names, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return _edited(rows, parsed).mapInArrow(run, "conv_id long, repaired_sha256 string")
