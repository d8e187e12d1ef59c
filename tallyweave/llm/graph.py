"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _size_and_mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(r)


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``(a, b)`` long pairs in, ``(node, component)`` out for every node that has an edge.

    ``component`` is the smallest node reachable. Each round hangs neighbours under the least of
    them by two grouped minima; edges never leave the executors. A round's hot node costs one
    partially aggregated minimum and one join row, which adaptive execution splits. Self-loops and
    repeated edges are ignored; nulls are not nodes; an empty table gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = checkpoint(edges)
    mark = _size_and_mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        # large star: neighbours above a node hang under the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, hang under the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        down = large.join(least, F.col("a") == F.col("u"))
        small = down.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = checkpoint(small.select("e.*").where("a <> b").distinct())
        now = _size_and_mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
