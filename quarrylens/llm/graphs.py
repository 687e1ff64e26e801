"""Connected components by minimum labels and pointer jumping, as joins and aggregates alone.

A node with many neighbours and a label of many nodes are hot keys of joins whose other side has one row a key, and
nothing after those joins needs their partitioning: adaptive execution splits such a partition as it grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def nearest_stars(links: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) with the same components as ``links`` (``a``, ``b``: a member and one of its leaders), but one a member.

    A member keeps the edge to its least leader; its other leaders get theirs to that one. Members mostly share their
    leaders, so what a group of many members leaves is little more than its members.
    """
    least = F.array_min("leaders")
    held = links.groupBy("a").agg(F.collect_set("b").alias("leaders"))  # one a tree at most
    edges = F.transform("leaders", lambda b: F.struct(F.when(b == least, F.col("a")).otherwise(b).alias("a"), least.alias("b")))
    return held.select(F.explode(edges).alias("e")).select("e.a", "e.b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (columns ``a`` and ``b``, both bigint).

    In each round a node takes the least label among its neighbours, then its label's label: paths halve, so rounds
    grow with the logarithm of the longest. Nothing but a count reaches the driver.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(edges.where("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("root"))
        after = staged(step.join(jump, "label").select("node", "was", F.least("label", "root").alias("component")))
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
