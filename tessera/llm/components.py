"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that an edge (columns a, b) touches.

    Each round points every node to its smallest neighbour, if that is smaller, follows the
    pointers to their ends by doubling, and carries the edges over to those, until none is left
    between different nodes.  What a round makes is written to the checkpoint folder, so that the next one reads a plain table
    and a hot node is only a skewed side of a join.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = None
    while nodes is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("n"), F.least("a", "p").alias("p")))
        moving = True
        while moving:
            ends = to.select(F.col("n").alias("m"), F.col("p").alias("q"))
            to = cut(to.join(ends, to.p == ends.m).select("n", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moving = not to.where("moved").isEmpty()
            to = to.select("n", "p")
        if nodes is None:
            nodes = to.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            nodes = nodes.join(to, nodes.component == to.n, "left").select("node", F.coalesce("p", "component").alias("component"))
        nodes = cut(nodes)
        moved = left.join(to, left.a == to.n).select(F.col("p").alias("a"), "b")
        moved = moved.join(to, moved.b == to.n).select("a", F.col("p").alias("b")).where("a <> b")
        left = cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return nodes
