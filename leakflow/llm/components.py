"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakflow.llm import staging
from leakflow.llm.staging import join_by_count, stage


def _digest(edges: DataFrame) -> tuple:
    """Rows, and an order-free sum over them; only these two numbers reach the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): ``edges``, of which there are ``total`` at most, with the smallest v of their u. Nothing but hot keys is broadcast."""
    if total <= staging.TASK_ROWS:
        return edges.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_by_count(edges, least, ["u"], "n", total, merge=True).select("u", "v", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u long, v long) undirected -> (node, root): each node that has an edge with the smallest node it reaches.

    Loops, repeated edges and null ends are ignored. The rounds are windows on
    narrow rows, or joins where these don't fit a task, of which the edges of
    a node with very many neighbours aren't shuffled; each round's edges are
    staged, so a lost executor repeats one round at most. The number of rounds grows with the logarithm of the
    longest path.
    """
    flat = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage(flat.filter("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = _digest(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        linked = _with_least(large, 2 * seen[0])
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        now = stage(small.filter("u <> v").distinct(), "edges")
        found = _digest(now)
        if found == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
