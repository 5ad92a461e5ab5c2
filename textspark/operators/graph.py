"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round every node points to the smallest node that its neighbours point to, then pointers are followed once more, so
    paths at least halve; rounds grow with the logarithm of the longest path. Edges within one group are
    dropped as they arise. Messages to a node are cut to the smallest one in each task before they move. Nulls are no nodes.
    """
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = checkpointed(pairs.where(F.col("a") != F.col("b")).distinct())
    parent = checkpointed(nodes.select("node", F.col("node").alias("component")))
    while not links.isEmpty():
        # a link between groups hangs the larger root under the smaller one
        low = links.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("to"))
        roots = checkpointed(low)
        # pointers go to smaller nodes only, so following them ends; twice in a round
        for _ in range(2):
            next_ = roots.select(F.col("node").alias("to"), F.col("to").alias("further"))
            roots = checkpointed(roots.join(next_, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
        moved = roots.select(F.col("node").alias("component"), "to")
        parent = checkpointed(parent.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        a = roots.select(F.col("node").alias("a"), F.col("to").alias("a_to"))
        b = roots.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        left = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        # pointers that have not reached their root are links of the next round
        links = checkpointed(left.where(F.col("a") != F.col("b")).union(_open(roots)).distinct())
    return parent


def _open(roots: DataFrame) -> DataFrame:
    """Links from where a pointer has come to where that one points itself."""
    next_ = roots.select(F.col("node").alias("to"), F.col("to").alias("further"))
    return roots.join(next_, "to").select(F.col("to").alias("a"), F.col("further").alias("b"))
