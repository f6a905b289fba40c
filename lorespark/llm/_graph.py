"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours move to its least neighbour. Small: its smaller ones and itself do."""
    out = edges.select("a", "b")
    both = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else out
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(least, "a")
    if large:
        moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of an edge (columns a, b of long); the label is the least node reachable.

    Each round writes its edges to the shared folder and deletes those of the round before. The number of rounds grows with the
    logarithm of the longest path. Raises if ``max_rounds`` do not suffice.
    """
    there = written()
    edges = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        before = written() - there
        edges = materialize(_star(_star(edges, True), False), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(a as decimal(38,0)) - b)")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()).distinct()
