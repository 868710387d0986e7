"""Connected components by alternating large and small stars, O(log^2 n) rounds, no component in one task."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges up to which a round's smallest neighbours (two longs a node) are broadcast, so that a hub's edges need not meet in one task.
BROADCAST_EDGES = 200_000


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b longs); the root is the component's smallest node.

    Beyond ``BROADCAST_EDGES`` a hub's edges are one side of a join that Spark splits when they are too many for one task.
    Each round is written to the shared folder, so a lost executor costs one round at most.  Rounds go on until the
    edges stop changing; when ``most_rounds`` of them do not suffice, that is an error.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = materialise(edges, "edges"), None
    few = edges.count() <= BROADCAST_EDGES  # rounds never add nodes
    sent = F.broadcast if few else (lambda df: df)
    for done in count():
        if done == most_rounds:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours go to the smallest.
        large = both.join(sent(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    # All edges are stars now: each node has one edge, to its root.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
