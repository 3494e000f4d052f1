"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once a pair."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .scratch import drop, store, store_filtered

#: The frequency sketch: so many counters, sent in so many slices. Its size never depends on the data.
SKETCH_BITS, SKETCH_SLICES = 20, 256
#: One shingle in so many (by hash) is a front shingle, whose document frequency is counted exactly.
FRONT = 4
#: Counters of the histogram that the suffix filter compares; each saturates at 255.
HISTOGRAM = 16


def _shingles(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, each text's range among them); a text of fewer than ``k`` words is one shingle."""
    for i, j, data, offsets in W.chunks(*W.text_bytes(batch.column("text"))):
        starts, ends, ranges = W.word_spans(data := W.lower_ascii(data), offsets)
        word = W.span_hashes(data, starts, ends)
        full = W.gram_hashes(word, k)[W.inner_starts(ranges, k)]
        n = np.diff(ranges)
        counts = np.maximum(n - k + 1, 0)
        if len(short := np.flatnonzero((n > 0) & (n < k))):
            at = np.concatenate([[0], np.cumsum(counts)])
            extra = np.array([W.gram_hashes(word[ranges[d] : ranges[d + 1]], int(n[d]))[0] for d in short], np.uint64)
            full = np.insert(full, at[short], extra)
            counts[short] = 1
        yield i, j, full, np.concatenate([[0], np.cumsum(counts)])


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """How common each shingle's counter is in the whole corpus, on a logarithmic scale of one byte (1 MiB in all)."""
    width = (1 << SKETCH_BITS) // SKETCH_SLICES

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, _, hashes, _ in _shingles(batch, k):
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        if total.any():
            kind = np.int32 if total.max() < 1 << 31 else np.int64
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([part.astype(kind).tobytes() for part in total.reshape(-1, width)], pa.binary())], ["slice", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(raw, np.int32 if len(raw) == 4 * width else np.int64).astype(np.int64)
        levels = [np.round(4 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])

    sliced = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(F.col("slice")).mapInArrow(add, "slice int, levels binary")
    out = np.zeros((SKETCH_SLICES, width), np.uint8)
    for s, raw in sliced.collect():  # 256 rows of 4 KiB, whatever the corpus
        out[s] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1)


def _is_front(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8)) % np.uint64(FRONT) == 0


def _key(own: np.ndarray) -> int:
    """64 bits that name a set of shingles."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _lone_fronts(docs: DataFrame, k: int) -> DataFrame:
    """``key``, ``lone``: how many front shingles of a set occur in no other set. No other set can share those."""

    def run(batches):
        for batch in batches:
            for i, j, hashes, at in _shingles(batch, k):
                tokens, keys = [], []
                for d in range(j - i):
                    own = np.unique(hashes[at[d] : at[d + 1]])
                    if len(own):
                        tokens.append(own[_is_front(own)].view(np.int64))
                        keys.append(np.full(len(tokens[-1]), _key(own), np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(keys))], ["token", "key"])

    fronts = docs.select("text").mapInArrow(run, "token long, key long").groupBy("token").agg(F.min("key").alias("key"), F.max("key").alias("other"))
    return fronts.where("key = other").groupBy("key").agg(F.count("*").cast("int").alias("lone"))


def _prefixes(docs: DataFrame, k: int, t: Fraction, levels: np.ndarray) -> DataFrame:
    extra = [c for c in docs.columns if c == "text_hash"]
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        import xxhash

        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, hashes, at in _shingles(batch, k):
                out: list[list] = [[] for _ in range(7)]
                rank = shared.value[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                for d in range(j - i):
                    own, first = np.unique(hashes[at[d] : at[d + 1]], return_index=True)
                    row = [len(own), *[None] * 6]
                    if len(own):
                        front = _is_front(own)
                        order = np.argsort(rank[at[d] : at[d + 1]][first], kind="stable")
                        plain = order[~front[order]]
                        length = len(own) - -(-t.numerator * len(own) // t.denominator) + 1
                        tokens = own[plain[:length]] if length <= len(plain) else np.concatenate([own[plain], own[front]])
                        hist = np.minimum(np.bincount((own & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM), 255).astype(np.uint8)
                        row[1:] = xxhash.xxh3_128_digest(own.tobytes()), _key(own), length, min(length, len(plain)), tokens.view(np.int64), hist.tobytes()
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *map(pa.array, out, kinds), *[batch.column(c).slice(i, j - i) for c in extra]], ["doc_id", "n", "digest", "key", "length", "plain", "tokens", "hist", *extra])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, key long, length int, plain int, tokens array<long>, hist binary" + ", text_hash long" * len(extra))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``key``, ``shingles`` of each row."""

    def run(batches):
        for batch in batches:
            for i, j, hashes, at in _shingles(batch, k):
                sets = [np.unique(hashes[at[d] : at[d + 1]]) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(own) for own in sets], pa.int64()), pa.array([own.tobytes() for own in sets], pa.binary())], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key long, shingles binary")


def _banded(listed: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Smaller and larger sides of all pairs, with bands of set sizes: sets that can be similar are in one band, or the larger
    one is in the next. So a common shingle's list is dealt over its sizes."""
    width = max(math.log(t.denominator / t.numerator), 1e-6) * (1 + 1e-9)
    band = F.floor(F.log("n") / width)
    return listed.withColumn("band", F.explode(F.array(band, band + 1))), listed.withColumn("band", band)


def _candidates(left: DataFrame, right: DataFrame, t: Fraction, where: str) -> DataFrame:
    """Distinct pairs a < b that share a prefix shingle (and band, if there are any) and that no filter excludes."""
    p, q = t.numerator, t.denominator
    least = f"ceil({p}D * (l.n + r.n) / {p + q})"  # overlap that similarity t asks for
    on = "l.token = r.token" + " and l.band = r.band" * ("band" in left.columns)
    pairs = left.alias("l").join(right.alias("r"), F.expr(on)).where(F.expr(f"l.key <> r.key and {where}"))
    pairs = pairs.where(F.expr(f"{p} * l.n <= {q} * r.n and {p} * r.n <= {q} * l.n"))  # length
    pairs = pairs.where(F.expr(f"1 + least(l.n - l.pos, r.n - r.pos) - 1 >= {least}"))  # positional: of the first shared shingle it is a bound
    pairs = pairs.selectExpr("least(l.key, r.key) a", "greatest(l.key, r.key) b", "l.hist x", "r.hist y", f"l.n + r.n - 2 * {least} most")

    def suffix(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HISTOGRAM).astype(np.int64) for c in (2, 3))
                ok = np.abs(x - y).sum(axis=1) <= batch.column(4).to_numpy(zero_copy_only=False)
                yield batch.select([0, 1]).filter(pa.array(ok))

    return pairs.mapInArrow(suffix, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs whose sets reach the similarity, by one exact intersection each."""
    p, q = t.numerator, t.denominator
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(q * same >= p * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()  # rows of one id can have the same set


def ngram_jaccard_join(docs: DataFrame, k: int = 5, threshold: str = "0.8", rounds: int = 1, hashes: bool = False, links: bool = False) -> DataFrame:
    """Link documents whose sets of distinct ``k``-word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row per row of ``docs`` that has an id: ``doc_id``, ``n_shingles`` (set size), ``component_id`` (smallest
    id that links lead to, itself included), ``class_id`` (smallest id with the same set; own id for an empty set), and
    with ``hashes`` ``text_hash`` (xxhash64 of the text), which tells the rows of one id apart, and with ``links`` ``n_links``,
    how many other rows with an id the row is linked with. Counting links compares all pairs of classes and leaves step 4
    out, so a group of n near copies costs up to n * n / 2 comparisons; components alone don't need that.

    Words are compared with A-Z lower-cased. A text of fewer than ``k`` words is one shingle; null or wordless texts are
    empty and linked with nothing. Rows with a null id are left out; a repeated row is returned as often as it occurs.
    Of an id with several texts each is a row by itself, with its own text's links. Columns other than ``doc_id`` and
    ``text`` are ignored.

    1. Shingles are ordered rare first: front shingles (one hash in four) that one set alone has, then the other hashes by
       the level of a sketch of fixed size that counts every shingle of the corpus, then the rest of the front.
    2. Equal sets become one class. Only classes are joined, so exact copies never make pairs.
    3. A class is listed under the shingles of its prefix, |x| - ceil(t|x|) + 1 long. Shingles that no other set has need no
       list, so most texts have none at all. Listed shingles of one class are dropped.
    4. ``rounds`` times every listed class is compared with one hub of each of its shingles, and links become components;
       classes of one component need no further comparison. So a group of n near copies costs n comparisons, not n * n / 2.
    5. All pairs still in different components are compared, whatever their number, but for those compared before: no link
       between components is lost, and no pair is verified twice.
    """
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    table = store(_prefixes(docs.withColumn("text_hash", F.xxhash64("text")) if hashes else docs, k, t, frequency_levels(docs, k)))
    classes = store(table.where("n > 0").groupBy("digest").agg(F.min("key").alias("key"), F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    lone = _lone_fronts(docs, k)
    reps = table.join(classes.select(F.col("digest").alias("d"), "rep"), F.expr("digest = d and doc_id = rep")).dropDuplicates(["digest", "doc_id"])
    open_reps = reps.join(lone, "key", "left").withColumn("lone", F.coalesce("lone", F.lit(0))).withColumn("more", F.col("length") - F.col("lone")).where("more > 0")
    # positions of front shingles behind the others aren't known; 0 makes the positional filter let them pass
    listed = open_reps.select("key", "rep", "n", "hist", "plain", "lone", F.posexplode(F.expr("if(more > plain, tokens, slice(tokens, 1, more))")).alias("at", "token"))
    listed = store(listed.select("key", "rep", "n", "hist", "token", F.expr("if(at < plain, lone + at, 0)").alias("pos")))
    shared = listed.groupBy("token").agg(F.count("*").alias("m"), F.min("rep").alias("first")).where("m > 1").drop("m")
    lists = store(listed.join(shared, "token").withColumn("first", F.col("rep") == F.col("first")).drop("rep"))
    drop(listed)
    # a text comes before its copies, so the class with the smallest id is the likeliest to be like the others
    hub = lists.where("first").groupBy("token").agg(F.min("key").alias("hub"))
    rounds = 0 if links else rounds
    linked = comps = None
    tried: list[DataFrame] = []
    for turn in range(rounds + 1):
        listed = lists.withColumn("comp", F.col("key"))
        if comps is not None:
            listed = lists.join(comps.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
        if turn:
            open_tokens = listed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("key").alias("hub")).where("lo < hi").select("token", "hub")
            listed, hub = listed.join(open_tokens.select("token"), "token", "left_semi"), open_tokens
        if turn < rounds:
            pairs = _candidates(listed, listed.join(hub, "token").where("key = hub"), t, "l.comp <> r.comp")
        else:
            pairs = _candidates(*_banded(listed, t), t, "(l.n < r.n or l.n = r.n and l.key < r.key) and l.comp <> r.comp")
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        pairs = store(pairs)
        tried.append(pairs)
        if pairs.isEmpty():
            continue
        ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes, "key").groupBy(F.col("rep").alias("doc_id")).agg(F.count("*").alias("sets"))
        ends = store(ends)
        sets = store_filtered(_sets(docs.join(ends.where("sets > 0"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), k))
        found = store(_verified(pairs, sets, t))
        drop(ends, sets)
        linked = found if linked is None else store(linked.union(found))
        comps = connected_components(linked)
    drop(lists, *tried)
    if comps is None:
        comps = classes.select(F.col("key").alias("node"), F.col("key").alias("component")).limit(0)
    least = comps.join(classes.select(F.col("key").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    comps = comps.join(least, "component").select(F.col("node").alias("key"), "least")
    named = classes.join(comps, "key", "left")
    if links:
        ends = classes.select("key", (F.col("members") - 1).alias("n"))
        if linked is not None:
            both = linked.select("a", "b").union(linked.select("b", "a")).toDF("key", "other")
            ends = ends.union(both.join(classes.select(F.col("key").alias("other"), F.col("members").alias("n")), "other").select("key", "n"))
        named = named.join(ends.groupBy("key").agg(F.sum("n").alias("n_links")), "key")
    count = ["n_links"] * links
    named = named.select(F.col("digest").alias("d"), F.col("rep").alias("class_id"), F.coalesce("least", "rep").alias("component_id"), *count)
    extra = [*["text_hash"] * hashes, *[F.coalesce(c, F.lit(0)).alias(c) for c in count]]
    out = table.select("doc_id", "n", "digest", *["text_hash"] * hashes).join(named, F.expr("digest = d"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), *extra)
