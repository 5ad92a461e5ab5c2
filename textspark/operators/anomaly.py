"""Anomalies in a series: random cut forest scores and the sigma rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import global_position


def _grow(values: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random cuts over sorted points: rows (low, high, cut, left, right, size), children by row number, −1 for leaves."""
    nodes: list[list[float]] = []
    stack = [(0, len(values), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        low, high = values[a], values[b - 1]
        if high <= low:
            nodes.append([low, high, low, -1, -1, b - a])
            continue
        cut = rng.uniform(low, high)
        split = a + int(np.searchsorted(values[a:b], cut, side="right"))
        split = min(max(split, a + 1), b - 1)
        nodes.append([low, high, cut, -1, -1, b - a])
        stack += [(a, split, me, 0), (split, b, me, 1)]
    return np.asarray(nodes, dtype=float)


def _tree_scores(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Expected displacement of every new point.

    At a node with range [low, high] a point outside it is cut off with probability
    extension / (range + extension); it then displaces the points of that node. The
    walk goes on for the points that were not cut off (Guha et al. 2016).
    """
    scores, alive = np.zeros(len(x)), np.ones(len(x))
    stack = [(0, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        low, high, cut, left, right, size = tree[node]
        v = x[at]
        extension = np.maximum(low - v, 0) + np.maximum(v - high, 0)
        reach = (high - low) + extension
        cut_off = np.divide(extension, reach, out=np.zeros_like(reach), where=reach > 0)
        scores[at] += alive[at] * cut_off * size
        alive[at] *= 1 - cut_off
        if left < 0:
            scores[at] += alive[at]
            continue
        goes_left = v <= cut
        for child, part in ((int(left), at[goes_left]), (int(right), at[~goes_left])):
            part = part[alive[part] > 0]
            if len(part):
                stack.append((child, part))
    return scores


def rcf_scores(df: DataFrame, key: str, col: str, trees: int = 50, samples: int = 512, seed: int = 42, out: str = "score") -> DataFrame:
    """(key, value, score): mean displacement over a random cut forest.

    The points for all trees are the trees·samples smallest seeded digests of the keys,
    found as a top-k without a full sort. Trees are grown in parallel, one group of at
    most ``samples`` points each, broadcast (about samples·trees nodes), and every row is
    scored where it is, in Arrow batches.
    """
    spark = df.sparkSession
    points = df.select(key, F.col(col).cast("double").alias("value")).filter(F.col("value").isNotNull())
    digest = F.xxhash64(F.col(key), F.lit(seed))
    pool = points.withColumn("_d", digest).orderBy("_d", key).limit(trees * samples).drop("_d")
    trees_of = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)), key)
    drawn = trees_of.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= samples)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["tree"].iloc[0])
        tree = _grow(np.sort(group["value"].to_numpy()), np.random.default_rng(seed * 100_003 + number))
        return pd.DataFrame({"tree": [number], "nodes": [tree.ravel()]})

    grown = drawn.select("tree", "value").groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").collect()
    forest = spark.sparkContext.broadcast([np.asarray(r["nodes"]).reshape(-1, 6) for r in sorted(grown, key=lambda r: r["tree"])])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch["value"].to_numpy()
            batch[out] = np.mean([_tree_scores(t, x) for t in forest.value], axis=0) if len(x) else []
            yield batch

    kind = points.schema[key].dataType.simpleString()
    return points.mapInPandas(score, f"{key} {kind}, value double, {out} double")


def sigma_bounds(df: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """One row: mean, population deviation and threshold."""
    stats = df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    return stats.withColumn("threshold", F.col("mean") + F.lit(float(k)) * F.col("std"))


def flag_sigma(df: DataFrame, col: str, k: float = 3.0, out: str = "anomaly") -> DataFrame:
    """Strictly above mean + k deviations is an anomaly."""
    bounds = sigma_bounds(df, col, k).select("threshold", F.lit(1).alias("_one"))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one").drop("_one")
    return joined.withColumn(out, F.col(col) > F.col("threshold"))


def anomaly_table(df: DataFrame, order: list[Column], value: str, score: str, k: float = 3.0) -> DataFrame:
    """(position, value, score, threshold, anomaly) per time step, positions from 0."""
    flagged = flag_sigma(df, score, k)
    placed = global_position(flagged, order, "_pos")
    return placed.select((F.col("_pos") - 1).alias("position"), F.col(value).alias("value"), F.col(score).alias("score"), "threshold", "anomaly")
