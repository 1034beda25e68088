"""Connected components by repeated hooking and contraction, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges`` (a, b): undirected. Returns (node, root): every node that has an edge, with the same
    root all over its component.

    In each round every node draws a priority, a hash of itself and the round, and hooks on the node of least priority within two
    steps, itself included; the edges are rewritten between the nodes hooked on. A star is done in one round, as all its leaves
    are within two steps of its least node. As priorities are drawn anew, no order of the ids makes long hooks: a chain
    of 100,000 nodes in order of their ids takes about ten rounds, and rounds grow with the logarithm of the longest path. A node with very many edges is met
    by partial aggregation and by joins of two stored tables, which Spark can split. Empty edges give no rows.
    """
    edges = ws.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        lows = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", drawn("b")).alias("low"))
        hooked = ws.save(lows.select(F.col("node").alias("b"), F.when(drawn("low") < drawn("node"), F.col("low")).otherwise(F.col("node")).alias("up")), "hooked")
        # a neighbour's least is the node itself at most, so the least of these is that of two steps
        reached = ws.save(both.join(hooked, "b").groupBy(F.col("a").alias("node")).agg(F.min_by("up", drawn("up")).alias("up")), "reached")
        a = reached.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = reached.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        half = ws.save(edges.join(a, "a").select("ua", "b"), "half")
        fresh = ws.save(half.join(b, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        if labels is None:
            relabelled, old = reached.select("node", F.col("up").alias("root")), []
        else:
            up = reached.select(F.col("node").alias("root"), "up")
            relabelled, old = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), [labels]
        labels = ws.save(relabelled, "labels")
        ws.drop(edges, half, hooked, reached, *old)
        edges = fresh
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
