"""Connected components of an edge table, by contraction to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); component is the smallest node reachable.

    Each round lets every node point to its smallest neighbour (or itself), jumps pointers
    twice, and contracts the edges to the roots; stars vanish in one round and the node count
    falls geometrically. Self-loops and repeated edges are harmless; an empty table gives an
    empty result. Only counts reach the driver.
    """
    live = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        parent = scratch.keep(parent)
        for _ in range(2):
            jump = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(jump, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        parent = scratch.keep(parent)
        to = lambda name: parent.select(F.col("node").alias(name), F.col("up").alias(f"{name}_up"))
        nxt = live.join(to("a"), "a").join(to("b"), "b").where("a_up <> b_up")
        nxt = scratch.keep(nxt.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        if labels is None:
            labels = parent.select("node", F.col("up").alias("component"))
        else:
            moved = parent.select(F.col("node").alias("component"), "up")
            labels = scratch.keep(labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        live = nxt
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
