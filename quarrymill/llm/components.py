"""Connected components of a graph in a table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) -> node, label: every node of an edge with the smallest node of its component.

    Each round every node points to the neighbour of least priority, a hash of the node, if that is less than its own; edges then join what their ends point to, without loops and repeats. A star ends in two rounds, and
    of a path a part of the nodes goes each round, so rounds grow with the logarithm of the longest path at most. A node's many neighbours meet only as a minimum, which is aggregated before the shuffle. Null ends and loops are ignored."""
    left = scratch.table(edges.select("a", "b").where("a <> b").distinct())
    nodes = scratch.table(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node")))
    while not left.isEmpty():
        near = left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        less = F.xxhash64("b") < F.xxhash64("a")
        to = scratch.table(near.where(less).select(F.col("a").alias("old"), F.col("b").alias("new")))
        moved = nodes.join(to, nodes["at"] == to["old"], "left").select("node", F.coalesce("new", "at").alias("at"))
        one = left.join(to, left["a"] == to["old"], "left").select(F.coalesce("new", "a").alias("a"), "b")
        both = one.join(to, one["b"] == to["old"], "left").select("a", F.coalesce("new", "b").alias("b"))
        both = both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        old = (left, nodes, to)
        left, nodes = scratch.table(both), scratch.table(moved)
        scratch.drop(*old)
    least = nodes.groupBy("at").agg(F.min("node").alias("label"))
    return nodes.join(least, "at").select("node", "label")
