"""Approximate nearest neighbours: p-stable hashing whose perturbed buckets are probed in order of estimated success."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import drop, store

#: Hash tables, and the bucket width (of unit vectors' standard normal projections).
TABLES, WIDTH = 8, 3.0
#: Projections and visited buckets a table for 512 vectors; a further projection for each ``GROWTH`` doublings of their number,
#: and with it so many times the visits. So buckets multiply with the vectors, and the share of them that is visited falls.
PROJECTIONS, PROBES, GROWTH, MORE = 9, 28, 2.25, 1.37
#: Index rows and queries of one bucket that meet in one task; larger buckets are dealt over several.
INDEX_BLOCK, QUERY_BLOCK = 4096, 2048


def layout(n: int) -> tuple[int, int]:
    """Projections and probes a table for an index of ``n`` vectors."""
    more = max(0, round(math.log2(max(n, 1) / 512) / GROWTH))
    return PROJECTIONS + more, round(PROBES * MORE**more)


def hash_family(dim: int, projections: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, TABLES * projections)), rng.uniform(0, WIDTH, TABLES * projections)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which is exact, so that squares neither overflow nor vanish, and their norms."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None]) if len(v) else v


def _keys(cells: np.ndarray) -> np.ndarray:
    """Bucket keys of cell coordinates (..., projections)."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(cells.shape[-1]):
            out = W.mix64(out * np.uint64(31) + cells[..., k].astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def probe_sequence(down: np.ndarray, up: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Perturbations of a cell in rising order of their score: the sum of squared distances to the crossed walls.

    ``down`` and ``up`` are the distances to both walls in each projection; the first perturbation is none at all.
    """
    walls = sorted([(float(x) ** 2, k, -1) for k, x in enumerate(down)] + [(float(x) ** 2, k, 1) for k, x in enumerate(up)])
    out: list[list[tuple[int, int]]] = [[]]
    heap: list[tuple[float, tuple[int, ...]]] = [(walls[0][0], (0,))] if walls else []
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        if len({walls[i][1] for i in chosen}) == len(chosen):
            out.append([walls[i][1:] for i in chosen])
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (score - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + walls[last + 1][0], (*chosen, last + 1)))
    return out


def _floats(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(-1, dim)


def _hashed(vectors: DataFrame, dim: int, kind: str, projections: int, probes: int) -> DataFrame:
    """(table, bucket, id, vector) rows: of each vector's own bucket, or with ``probes`` of the buckets that a query visits."""
    planes, shift = hash_family(dim, projections)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a in range(0, len(ids), 1024):
                part = batch.slice(a, 1024)
                u = _unit(_floats(part.column("vector"), dim, kind))
                place = ((u / np.sqrt((u * u).sum(axis=1))[:, None]) @ planes + shift) / WIDTH
                cells = np.floor(place).astype(np.int64).reshape(-1, TABLES, projections)
                if probes:
                    rest = (place - np.floor(place)).reshape(cells.shape)
                    rows, all_cells = [], []
                    for i in range(len(cells)):
                        for t in range(TABLES):
                            steps = probe_sequence(rest[i, t], 1 - rest[i, t], probes)
                            seen = np.repeat(cells[i, t][None], len(steps), axis=0)
                            for n, step in enumerate(steps):
                                for k, d in step:
                                    seen[n, k] += d
                            rows += [(i, t)] * len(steps)
                            all_cells.append(seen)
                    at = np.array(rows, np.int64)
                    keys = _keys(np.concatenate(all_cells))
                else:
                    at = np.stack([np.repeat(np.arange(len(cells)), TABLES), np.tile(np.arange(TABLES), len(cells))], axis=1)
                    keys = _keys(cells).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 1].astype(np.int32)), pa.array(keys), pa.array(ids[a : a + 1024][at[:, 0]]), part.column("vector").take(pa.array(at[:, 0]))], ["tab", "bucket", "id", "vector"])

    return vectors.mapInArrow(run, "tab int, bucket long, id long, vector binary")


def _best(queries: tuple[np.ndarray, np.ndarray], index: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of a block for each query by exact cosine, ties to the smaller id."""
    (q_ids, q), (ids, v) = queries, index
    q, v = _unit(q), _unit(v)
    q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    rough = q @ v.T / q_norm[:, None] / v_norm
    n = min(len(ids), k)
    floor = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - 1e-9
    row, col = np.nonzero(rough >= floor[:, None])  # all near the k-th, so that rounding decides no tie
    score = np.einsum("ij,ij->i", q[row], v[col]) / (q_norm[row] * v_norm[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(q_ids)))
    keep = np.arange(len(row)) - first[row] < k
    return q_ids[row[keep]], ids[col[keep]], score[keep]


def _met(rows: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """Per block (rows sorted by block and kind, index rows first): each query's k nearest."""

    def run(batches):
        key, held = None, [[], []]
        out: list[list[np.ndarray]] = [[], [], []]

        def close():
            if held[0] and held[1]:
                sides = [(np.concatenate([x[0] for x in h]), np.concatenate([x[1] for x in h])) for h in held]
                for o, x in zip(out, _best(sides[1], sides[0], k), strict=True):
                    o.append(x)

        def flush():
            flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
            for o in out:
                o.clear()
            return pa.RecordBatch.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))], ["query_id", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tab", "bucket", "i_salt", "q_salt", "kind")], axis=1)
            ids = batch.column("id").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(ids)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key != (now := tuple(keys[a, :4])):
                    close()
                    key, held = now, [[], []]
                held[int(keys[a, 4])].append((ids[a:b], _floats(batch.column("vector").slice(a, b - a), dim, kind)))
            if sum(len(x) for x in out[0]) > 1 << 16:
                yield flush()
        close()
        yield flush()

    return rows.mapInArrow(run, "query_id long, id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``vectors(vec_id, embedding)`` by cosine for each row of ``queries``: ``query_id``, ``rank``,
    ``vec_id``, ``score``; a row is no neighbour of its own id. Ties go to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most take no part; ids
    that are null neither. Of rows that repeat an id one counts, the one whose vector is least as bytes (an id has one vector, in the
    index and as a query). Other columns are ignored. With fewer
    candidates than ``k`` a query has them all: one that met fewer than ``k`` is compared with the whole index.

    Every row is indexed: equal vectors as one, with their ``k + 1`` smallest ids, which are all that can be among the
    nearest. A query meets its buckets' blocks and keeps ``k + 1`` of each; what comes together for it depends on tables,
    probes and k only. Nothing is fitted to the data but the number of projections and probes to the number of vectors
    (:func:`layout`; ``probes`` overrides the latter). Vectors travel in the type that they came in.
    """
    usable = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    read = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable)
    dim, rows = read(vectors).agg(F.mode(F.size("embedding"), True), F.count("*")).first()
    dim, (projections, most) = dim or 1, layout(rows)
    kind = "<f4" if {df.schema["embedding"].dataType.elementType.typeName() for df in (vectors, queries)} == {"float"} else "<f8"

    def pack(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            raw = flat.reshape(-1, dim) + 0.0  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "vector"])

    one = lambda df: read(df).where(F.size("embedding") == dim).mapInArrow(pack, "id long, vector binary").groupBy("id").agg(F.min("vector").alias("vector"))
    packed = one(vectors)
    few = packed.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= k + 1)
    members = few.groupBy("vector").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids"))
    asked = one(queries)
    index, visits = store(_hashed(members.select("id", "vector"), dim, kind, projections, 0)), store(_hashed(asked, dim, kind, projections, probes or most))
    sizes = index.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / INDEX_BLOCK).cast("int").alias("i_salts"))
    asks = visits.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_salts"))
    buckets = sizes.join(asks, ["tab", "bucket"])

    def dealt(rows: DataFrame, kind: int, buckets: DataFrame) -> DataFrame:
        own, other = ("i_salt", "q_salt") if kind == 0 else ("q_salt", "i_salt")
        rows = rows.join(buckets, ["tab", "bucket"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        return rows.select("tab", "bucket", "i_salt", "q_salt", F.lit(kind).alias("kind"), "id", "vector")

    def met(index: DataFrame, visits: DataFrame, buckets: DataFrame) -> DataFrame:
        both = dealt(index, 0, buckets).union(dealt(visits, 1, buckets)).repartition("tab", "bucket", "i_salt", "q_salt").sortWithinPartitions("tab", "bucket", "i_salt", "q_salt", "kind")
        return _met(both, dim, kind, k + 1).groupBy("query_id", "id").agg(F.max("score").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
        expanded = found.join(members.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = store(ranked(met(index, visits, buckets)))
    drop(index, visits)
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = store(asked.join(full, F.col("id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return found
    whole = lambda df: df.select(F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket"), "id", "vector")
    only = members.agg(F.ceil(F.count("*") / INDEX_BLOCK).cast("int").alias("i_salts")).crossJoin(short.agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_salts")))
    exact = ranked(met(whole(members), whole(short), F.broadcast(only.where("i_salts > 0").select(F.lit(0).alias("tab"), F.lit(0).cast("long").alias("bucket"), "i_salts", "q_salts"))))
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(exact)
