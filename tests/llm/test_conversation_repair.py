"""Repair against a cubic CYK table over all splits, and against all edit sequences of short conversations."""

import hashlib
import itertools
import re
import zlib

import numpy as np

from lagframe.llm import conversation_repair as R

LANGUAGE = re.compile("(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def all_edits(rows):
    """The least (cost, audit) over every sequence of edits with up to four insertions."""
    kinds = faults(rows)
    best = None
    for choice in itertools.product("KuaD", repeat=len(rows)):
        if any(k in ("blank", "duplicate") and c != "D" for k, c in zip(kinds, choice, strict=True)):
            continue
        cost = sum({"K": 0, "u": 3, "a": 3, "D": 4}[c] + (3 if k == "truncated" and c != "D" else 0) for k, c in zip(kinds, choice, strict=True))
        base = [("D", "") if c == "D" else ("K", rows[i][1][:1] or "?") if c == "K" else ("R", c) for i, c in enumerate(choice)]
        for n in range(5):
            if best is not None and cost + 3 * n > best[0]:
                break
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for what in itertools.product("ua", repeat=n):
                    line = []
                    for i in range(len(rows) + 1):
                        line += [("I", w) for p, w in zip(places, what, strict=True) if p == i]
                        line += base[i : i + 1]
                    if LANGUAGE.fullmatch("".join(x[1] for x in line)) and (best is None or (cost + 3 * n, "".join(x[0] for x in line)) < best):
                        best = (cost + 3 * n, "".join(x[0] for x in line))
    return best


def cubic(rows):
    """CYK over all spans and all their splits, with the grammar of one-turn symbols U, A, Y and pairs P."""
    kinds, n = faults(rows), len(rows)
    cell: dict[tuple[int, int], dict[str, tuple[int, str]]] = {}

    def put(at, symbol, value):
        if symbol not in at or value < at[symbol]:
            at[symbol] = value

    def close(at, i, j):
        while True:
            before = dict(at)
            for top, a, b in rules:
                for x, y in ((at, cell[i, i]), (cell[i, i], at)):
                    if a in x and b in y:
                        put(at, top, (x[a][0] + y[b][0], x[a][1] + y[b][1]))
            if at == before:
                return

    rules = [("P", "U", "A"), ("P", "P", "P"), ("T", "Y", "P"), ("E", "E", "E")] + [r for x in "UAYPT" for r in ((x, x, "E"), (x, "E", x))]
    empty = {"E": (0, ""), "U": (3, "I"), "A": (3, "I"), "P": (6, "II")}
    for i in range(n + 1):
        cell[i, i] = dict(empty)
    for i, (_, role, _) in enumerate(rows):
        at: dict[str, tuple[int, str]] = {"E": (4, "D")}
        if kinds[i] not in ("blank", "duplicate"):
            extra = 3 if kinds[i] else 0
            for symbol in "UA":
                put(at, symbol, (extra, "K") if role[:1] == symbol.lower() else (3 + extra, "R"))
            if role[:1] == "s":
                put(at, "Y", (extra, "K"))
        close(at, i, i + 1)
        cell[i, i + 1] = at
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            at = {}
            for k in range(i + 1, i + length):
                for top, a, b in rules:
                    x, y = cell[i, k], cell[k, i + length]
                    if a in x and b in y:
                        put(at, top, (x[a][0] + y[b][0], x[a][1] + y[b][1]))
            close(at, i, i + length)
            cell[i, i + length] = at
    return min(v for k, v in cell[0, n].items() if k in "EPT")


def repaired(rows, audit):
    out, i = [], 0
    state = ""
    for edit in audit:
        if edit != "I":
            _, role, text = rows[i]
            i += 1
            if edit == "D":
                continue
        name = role if edit == "K" else "assistant" if state == "u" else "user"
        out.append((name, "" if edit == "I" else text))
        state = name[0]
    return out


def random_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", "usher"], ["Yes.", "no", " ", "", "Why?\n", "a b", "ok!", "Fine.", "más…"]
    return [(int(rng.integers(0, 8)) if rng.random() < 0.9 else None, str(rng.choice(roles, p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05])), str(rng.choice(texts)) + ("" if rng.random() < 0.3 else str(rng.integers(9)) + rng.choice([".", ""]))) for _ in range(n)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def check(spark, talks, splits=None):
    rows = [(c, *r, "x") for c, talk in talks.items() for r in talk]
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "conv_id long, turn long, role string, text string, cost string")
    df = df.repartition(splits) if splits else df
    parsed = R.parse(df).cache()
    got = {r.conv_id: r for r in parsed.collect()}
    digests = {r.conv_id: r.repaired_sha256 for r in R.repaired_digests(df, parsed).collect()}
    turns = {}
    for r in sorted(R.repaired_turns(df, parsed).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(talks) == set(digests)
    for c, talk in talks.items():
        own, r = ordered(talk), got[c]
        kinds = faults(own)
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), pairs)
        assert (r.cost, r.audit) == (all_edits(own) if len(own) <= 4 else cubic(own))
        want = repaired(own, r.audit)
        assert turns.get(c, []) == want and LANGUAGE.fullmatch("".join(role[0] for role, _ in want))
        assert digests[c] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in want).encode()).hexdigest()


def test_short_conversations(spark):
    rng = np.random.default_rng(1)
    check(spark, {c if c else None: random_rows(rng, int(rng.integers(1, 5))) for c in range(120)})


def test_long_conversations_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    talks = {c: random_rows(rng, int(rng.integers(5, 12))) for c in range(30)}
    talks[50] = [(int(t), r, x) for t, (_, r, x) in enumerate(random_rows(rng, 60))]
    talks[51] = [(1, "user", "Same.")] * 40
    talks[52] = [(t, "user", "Same.") for t in range(30)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, talks, 16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_any_split_gives_the_same_cells():
    rng = np.random.default_rng(3)
    for _ in range(50):
        leaves = [R.deleted_cells(1) if rng.random() < 0.2 else R.turn_cells(str(rng.choice(["u", "a", "s", "t"])), bool(rng.random() < 0.4)) for _ in range(9)]

        def tree(a, b):
            if b - a == 1:
                return leaves[a]
            k = int(rng.integers(a + 1, b))
            return R.combine(tree(a, k), tree(k, b))

        first = tree(0, 9)
        assert all(tree(0, 9) == first for _ in range(4))


def test_nothing_and_absent_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.parse(empty).count() == 0 and R.repaired_turns(empty).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "Hi.", 0), (2, 1, "user", "Hi.", 3), (2, 2, "assistant", "Ho.", 1)], "conv_id long, turn long, role string, text string, copies int")
    parsed = R.parse(gone)
    assert sorted(map(tuple, parsed.collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 2, 0, 2, 8, "KDDK")]
    assert {r.conv_id: r.repaired_sha256 for r in R.repaired_digests(gone, parsed).collect()}[1] == hashlib.sha256(b"").hexdigest()


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t in (0, 1, None) for r, x in (("assistant", "A. b!"), (None, None))]
    got = R.damage(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")).collect()
    want = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
        want.append((c, t, "user" if f == 4 else r, x, 0 if f == 0 else 2 if f == 3 else 1))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
