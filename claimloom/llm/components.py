"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) rows -> (node, root): every node of an edge with the smallest node it reaches.

    Each round hooks every node to its smallest neighbour, follows the parents to their end by
    doubling, and contracts the edges. A node that is no local minimum merges, so at least half of
    them go in each round, whatever the shape; chains cost the logarithm of their length. All steps
    are joins and partial aggregates: a hub's edges are pre-aggregated before its shuffle and its
    join partition can be split. Null ends are ignored, as are loops and repeated edges; an empty
    table gives an empty one.
    """
    spool = Spool(edges.sparkSession, "components")
    e = spool.cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.union(e.select("b", "a"))
        parent = spool.cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p")))
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jump = spool.cut(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            spool.drop(parent)
            if jump.where("moved").isEmpty():
                break
            parent = jump
        if nodes is None:
            now = jump.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            now = nodes.join(jump.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        now = spool.cut(now)
        left = jump.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        smaller = e.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        smaller = spool.cut(smaller)
        for old in (e, jump, *([] if nodes is None else [nodes])):
            spool.drop(old)
        e, nodes = smaller, now
    else:
        if not e.isEmpty():
            raise RuntimeError(f"the components have not settled after {max_rounds} rounds")
    if nodes is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes
