"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregation and a join, so no adjacency list is ever held by one
task; a node that neighbours a third of all others is cut by partial aggregation and by
the planner's skew-join splitting. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import shared_table


def _state(edges: DataFrame) -> tuple:
    """Order-free digest of an edge set (two aggregates, nothing is collected)."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that has an edge; component = smallest node.

    ``edges`` are undirected pairs of longs. Nulls and self loops are dropped, repeats are
    harmless, an empty input gives an empty result.
    """
    e = (
        edges.select(F.col(src).cast("long").alias("x"), F.col(dst).cast("long").alias("y"))
        .filter("x <> y")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    e = shared_table(e)
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    while True:
        # large star: every larger neighbour of u points at the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = shared_table(low.select("u", F.least("u", "m").alias("m")))  # both sides dealt anew: a hub is split
        large = (
            both.filter("b > a")
            .join(low, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = shared_table(large)
        # small star: u and its smaller neighbours point at the smallest of them
        low = shared_table(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = (
            large.join(low, F.col("a") == F.col("u"))
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        e = shared_table(small)
        after = _state(e)
        if after == before:
            break
        before = after
    # at the fixed point every node points at its component's smallest node
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
