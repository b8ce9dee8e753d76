"""Connected components of a graph given as a table of edges, by hooking and pointer jumping in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kveil.session import cut_lineage

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; root is the least node reachable.

    Each round turns every edge's ends into their present roots, hooks each root to the least root
    next to it, and halves the paths; edges within one component go. The number of rounds grows
    with the logarithm of the longest chain. Every round is a written table, so lost executors
    repeat at most one. Hubs are no hot keys: least neighbours are summed before the shuffle, and the joins
    have one row per node on one side, so Spark can split the other.
    """
    todo = cut_lineage(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    )
    nodes = todo.select(F.col("a").alias("node")).union(todo.select("b")).distinct()
    parent = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    for _ in range(MAX_ROUNDS):
        if todo.isEmpty():
            return parent
        both = todo.select("a", "b").union(todo.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        hooks = least.select(F.col("a").alias("root"), F.least("a", "b").alias("up"))
        hooks = cut_lineage(compress(cut_lineage(hooks)))
        parent = cut_lineage(
            parent.join(hooks, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        )
        ends = todo.join(hooks.select(F.col("root").alias("a"), F.col("up").alias("ra")), "a")
        ends = ends.join(hooks.select(F.col("root").alias("b"), F.col("up").alias("rb")), "b")
        todo = cut_lineage(
            ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b").distinct()
        )
    raise RuntimeError("components did not settle")


def compress(hooks: DataFrame) -> DataFrame:
    """One step of pointer jumping: each root goes where its new root goes."""
    beyond = hooks.select(F.col("root").alias("up"), F.col("up").alias("far"))
    return hooks.join(beyond, "up", "left").select("root", F.coalesce("far", "up").alias("up"))
