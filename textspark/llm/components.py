"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textspark.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller
    ones; paths halve, so rounds grow with the logarithm of the longest path. A node of many
    links is summed per task first, and its links are a plain join that Spark can split.
    Each round is a table in the shared folder. Nulls are no nodes.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = written(pairs.distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(b > a).join(lowest, "a").select(b.alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where(b != F.col("low")).select(b.alias("a"), F.col("low").alias("b"))
        now = written(small.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct(), "edges")
    root = now.select(b.alias("node"), b.alias("component")).distinct()
    return now.select(a.alias("node"), b.alias("component")).unionByName(root)
