"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, store


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links(a, b)``; the component is its smallest node.

    Large-star and small-star rounds: every node's larger neighbours, then its smaller ones, are linked to its smallest
    neighbour until nothing changes. A round is two aggregations with partial sums and two joins, so a hub with a third of
    all links is split like any skewed join; the number of rounds grows with the logarithm of the longest path. Each
    round's links are a table in the shared folder. Self-links and repeated links are harmless; null ends are ignored.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = store(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = after
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
