"""Nearest neighbours against brute force, and preference pairs."""

import numpy as np

from lagframe.llm import ann, chat, queries

from ..compare import DATA


def brute(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        if q in good:
            s = sorted((-round(float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), 12), i) for i, v in good.items() if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_edge_cases_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, rng.standard_normal(4)))) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 400)] + [(500, [2.0, 4.0, 6.0, 8.0]), (501, [1e200, 2e200, 3e200, 4e200]), (502, [1e-200, 2e-200, 3e-200, 4e-200])]
    rows += [(600, None), (601, [0.0] * 4), (602, [1.0, None, 0.0, 0.0]), (603, [1.0, float("nan"), 0.0, 0.0]), (604, [float("inf"), 0.0, 0.0, 0.0]), (605, [1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    asked = [0, 3, 50, 100, 250, 399, 600, 601, 602]
    out = ann.nearest(df, df.where(df.vec_id.isin(asked)), 5, probes=300).toPandas()
    got = out.sort_values("rank").groupby("query_id").vec_id.apply(list).to_dict()
    want = brute([r for r in rows if r[0] not in (501, 502)], asked, 5)
    assert {q: got[q] for q in (100, 250, 399)} == {q: want[q] for q in (100, 250, 399)}
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in (0, 3, 50)]) >= 0.8
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_one_id_with_two_vectors(spark):
    """The vector that is least as bytes is the id's."""
    rng = np.random.default_rng(8)
    rows = [(i, list(map(float, rng.standard_normal(4)))) for i in range(40)] + [(7, [5.0, 1.0, 0.5, 0.0]), (3, [0.0, 0.0, 1.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id in (7, 11)"), 6, probes=400).toPandas().sort_values("rank")
    own = {}
    for i, v in rows:
        own[i] = min(own.get(i, v), v, key=lambda x: np.array(x).tobytes())
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for q in (7, 11):
        want = sorted((-cos(own[q], w), i) for i, w in own.items() if i != q)[:6]
        mine = got[got.query_id == q]
        assert list(mine.vec_id) == [i for _, i in want] and np.allclose(mine.score, [-s for s, _ in want])


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((4, 128))
    v = np.concatenate([v, -v[:2]])
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in (5, 8):
        out = ann.nearest(df, df, k).toPandas().sort_values(["query_id", "rank"])
        assert len(out) == 30 and out.groupby("query_id")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5]).all()
        for q, own in out.groupby("query_id"):
            assert own.vec_id.tolist() == [i for i in np.argsort(-(u @ u[q])).tolist() if i != q]


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    out = ann.nearest(e, e.where("vec_id % 50 = 0")).toPandas()
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        best = ids[np.argsort(-s)[:5]]
        own = out[out.query_id == ids[q]].sort_values("rank")
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 5
        assert np.allclose(own.score, [s[ids == i][0] for i in own.vec_id]) and list(own["rank"]) == [1, 2, 3, 4, 5]
    assert hit / total >= 0.9


def test_probes_rise_in_score():
    rng = np.random.default_rng(1)
    down = rng.random(5)
    seq = ann.probe_sequence(down, 1 - down, 50)
    cost = [sum((down[k] if d < 0 else 1 - down[k]) ** 2 for k, d in s) for s in seq]
    assert seq[0] == [] and cost == sorted(cost) and len({tuple(sorted(s)) for s in seq}) == 50


def test_the_compared_share_falls_as_vectors_grow():
    rng = np.random.default_rng(9)
    shares = []
    for n in (500, 2000, 8000):
        u = rng.standard_normal((n, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        projections, probes = ann.layout(n)
        planes, shift = ann.hash_family(64, projections)
        place = ((u @ planes + shift) / ann.WIDTH).reshape(n, ann.TABLES, projections)
        cells = np.floor(place).astype(np.int64)
        keys, met, found = ann._keys(cells), 0, 0
        for q in range(20):
            near = np.zeros(n, bool)
            for t in range(ann.TABLES):
                rest = place[q, t] - cells[q, t]
                steps = ann.probe_sequence(rest, 1 - rest, probes)
                seen = np.repeat(cells[q, t][None], len(steps), axis=0)
                for i, step in enumerate(steps):
                    for k, d in step:
                        seen[i, k] += d
                near |= np.isin(keys[:, t], ann._keys(seen))
            score = u @ u[q]
            score[q] = -9
            met, found = met + near.mean() / 20, found + near[np.argsort(-score)[:5]].mean() / 20
        assert found >= 0.9
        shares.append(met)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.7


def test_preference_format(spark):
    t = lambda *xs: [{"turn": i, "role": r, "text": x} for i, (r, x) in enumerate(xs)]
    kind = "array<struct<turn: bigint, role: string, text: string>>"
    rows = [
        (1, t(("user", "hi"), ("assistant", "good"), ("user", "more")), t(("user", "hi"), ("assistant", "bad"))),
        (2, t(("user", "a")), t(("user", "a"))),
        (3, None, t(("assistant", "é"))),
        (4, t(("user", "x"), ("assistant", "y")), t(("user", "x"))),
    ]
    got = {r.pair_id: r for r in chat.preference_format(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    r = got[1]
    assert (r.prompt_turns, r.prompt) == (1, "<|user|>\nhi\n")
    assert r.chosen == "<|assistant|>\ngood\n<|user|>\nmore\n" and [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["good"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["bad"]
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    assert (got[3].prompt, got[3].chosen, [got[3].rejected[s.start : s.end] for s in got[3].rejected_mask]) == ("", "", ["é"])
    assert (got[4].prompt_turns, got[4].chosen, got[4].rejected) == (1, "<|assistant|>\ny\n", "")


def test_null_turns_and_long_differences(spark):
    kind = "array<struct<turn: bigint, role: string, text: string>>"
    turns = lambda *xs: [x and {"turn": i, "role": x[0], "text": x[1]} for i, x in enumerate(xs)]
    many = [("assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    rows = [
        (1, turns(("user", "q"), ("assistant", None)), turns(("user", "q"), ("assistant", "bad"))),
        (2, turns(("user", None), ("assistant", "a")), turns(("user", None), ("assistant", "b"))),
        (3, turns(None, ("user", "q")), turns(("user", "q"))),
        (4, turns(*many), turns(*many[:2], ("user", "other"), *many[3:])),
    ]
    got = {r.pair_id: r for r in chat.preference_format(spark.createDataFrame(rows, f"pair_id long, chosen {kind}, rejected {kind}")).collect()}
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (1, "<|assistant|>\n\n", "<|assistant|>\nbad\n")
    assert [(s.start, s.end) for s in got[1].chosen_mask] == [(14, 14)]
    assert got[2].prompt_turns == 1 and got[2].prompt == "<|user|>\n\n"
    assert got[3].prompt_turns == 1 and got[3].chosen == got[3].rejected == ""
    assert got[4].prompt_turns == 2
    assert [got[4].chosen[s.start : s.end] for s in got[4].chosen_mask] == [x for r, x in many[2:] if r == "assistant"]


def test_stale_replies(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "bye"), (1, 3, "assistant", "a2"), (2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, "user", "q"), (None, 0, "assistant", "z"), (4, 0, None, "q"), (4, 1, "assistant", "x")]
    out = {r.pair_id: r for r in chat.preference_format(chat.stale_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(out) == {1, 2, 4}
    assert (out[1].prompt_turns, out[1].chosen, out[1].rejected) == (3, "<|assistant|>\na2\n", "<|assistant|>\na1\n")
    assert (out[2].prompt_turns, out[2].chosen) == (2, "")
    assert out[4].rejected == "<|assistant|>\n\n" and out[4].prompt == "<||>\nq\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_format(chat.stale_reply_pairs(empty)).count() == 0


def test_query_returns_the_masks(spark):
    out = queries.op9_chat_preference(spark, DATA).collect()
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").where("role = 'assistant'").distinct().collect()
    assert {r.pair_id for r in out} == {r.conv_id for r in rows}
    said = {}
    for r in rows:
        said.setdefault(r.conv_id, []).append((r.turn, r.text or ""))
    changed = 0
    for r in out:
        own = [x for _, x in sorted(said[r.pair_id])]
        want = [own[-1]], [own[-2] if len(own) > 1 else ""]
        if want[0] == want[1]:
            want = [], []
        changed += bool(want[0])
        cut = lambda text, mask: [text[int(s.split("-")[0]) : int(s.split("-")[1])] for s in mask.split()]
        assert (cut(r.chosen, r.chosen_mask), cut(r.rejected, r.rejected_mask)) == want
    assert changed > 0
