"""Connected components of a graph of integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component, for all nodes that have an edge.

    ``edges`` has ``a`` and ``b``, long; loops, repeats and nulls have no effect. In each
    round every node moves to the node of lowest priority within two steps, and what is
    left between the places moved to are the next round's edges. Priorities are hashes
    that differ by round, so chains shrink as stars do, by a constant factor at least.
    Nothing is gathered per node or component: aggregates are partial, and joins are with
    written tables of a row per node, so that the side of a hub's edges can be split.

    Returns ``node, component``.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    placed, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.xxhash64("b", F.lit(turn))
        near = both.groupBy("a").agg(F.min_by("b", rank).alias("to"), F.min(rank).alias("rank"))
        own = F.xxhash64("a", F.lit(turn))
        near = near.select(
            F.col("a").alias("node"),
            F.when(F.col("rank") < own, F.col("to")).otherwise(F.col("a")).alias("to"),
            F.least("rank", own).alias("rank"),
        )
        near = written(near, "near")
        far = (
            both.join(near, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min_by("to", "rank").alias("far"), F.min("rank").alias("far_rank"))
        )
        moves = written(
            near.join(far, F.col("node") == F.col("a")).select(
                "node", F.when(F.col("far_rank") < F.col("rank"), F.col("far")).otherwise(F.col("to")).alias("to")
            ),
            "moves",
        )
        for end in ("a", "b"):
            edges = edges.join(moves, F.col(end) == F.col("node")).drop(end, "node").withColumnRenamed("to", end)
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if placed is None:
            placed = moves.select("node", F.col("to").alias("root"))
        else:
            step = moves.select(F.col("node").alias("n"), "to")
            placed = written(
                placed.join(step, F.col("root") == F.col("n"), "left").select(
                    "node", F.coalesce("to", "root").alias("root")
                ),
                "placed",
            )
        turn += 1
    if placed is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Written, so that a giant component's join can be split.
    smallest = written(placed.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    return placed.join(smallest, "root").select("node", "component")
