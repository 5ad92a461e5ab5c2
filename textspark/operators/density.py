"""Density topics: DBSCAN of vectors over a cluster, exact, with the number of topics from the data.

Equal vectors are one point with a weight. A bounded sample of points are pivots; a point is at home in the cell of the nearest one and is
copied to each cell whose pivot is at most two radii farther away. By the triangle inequality all
neighbours of a point are then in its home cell, so whether it is a core point, and which core points it touches, is decided
there alone. Groups that meet in copied points are joined by connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .graph import connected_components
from .scale import checkpointed, global_position

CELL = 4000  # points a cell is meant to hold; a target, not a cap
PIVOTS = 4096  # at most, so that they can go to every task; cells grow beyond that
ROWS = 256


def _near(block: np.ndarray, points: np.ndarray, radius: float) -> np.ndarray:
    """(block, points) whether two are within the radius; what rounding leaves open is computed again by differences."""
    square = (block * block).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * (block @ points.T)
    limit = radius * radius
    near = square <= limit
    scale = max(float((block * block).sum(1).max(initial=0.0)), float((points * points).sum(1).max(initial=0.0)), limit)
    i, j = np.nonzero(np.abs(square - limit) <= 1e-9 * scale)
    if len(i):
        difference = block[i] - points[j]
        near[i, j] = np.sqrt((difference * difference).sum(1)) <= radius
    return near


def _cells(points: DataFrame, radius: float, cell: int) -> DataFrame:
    """(cell, home, id, n, v): each point at home, and its copies."""
    wanted = min(PIVOTS, max(1, math.ceil(points.count() / cell)))
    pivots = np.array([r["v"] for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()])
    if not len(pivots):
        return points.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"), "id", "n", "v")

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                v = np.array(batch.column(2).to_pylist())
                away = np.sqrt(((v[:, None, :] - pivots[None]) ** 2).sum(2)) if len(pivots) * v.size < 1 << 24 else np.stack([np.sqrt(((pivots - x) ** 2).sum(1)) for x in v])
                home = away.argmin(1)
                at, to = np.nonzero(away <= away.min(1)[:, None] * (1 + 1e-12) + 2 * radius * (1 + 1e-9))
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(home[at] == to), *rows.columns], ["cell", "home", "id", "n", "v"])

    schema = points.select("id", "n", "v").schema
    return points.select("id", "n", "v").mapInArrow(run, StructType([StructField("cell", LongType()), StructField("home", BooleanType()), *schema.fields]))


def _table(part: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray, np.ndarray]:
    v = np.array(part.column("v").to_pylist(), np.float64)
    return v, part.column("home").to_numpy(zero_copy_only=False), part.column("id"), part.column("n").to_numpy()


def clusters(points: DataFrame, radius: float, least: int, cell: int = CELL) -> DataFrame:
    """(id, cluster) of the points (id, n, v) that are core points or within the radius of one.

    A core point has at least ``least`` points, itself counted and each ``n`` times, within the radius. A cluster is
    named by its smallest core point; a point at the border of several goes to the one with the smallest name.
    """
    dealt = checkpointed(_cells(points, radius, cell))
    id_field = dealt.schema["id"]

    def count(part: pa.Table) -> pa.Table:
        v, home, ids, n = _table(part)
        own = np.flatnonzero(home)
        core = np.zeros(len(own), bool)
        for i in range(0, len(own), ROWS):
            core[i : i + ROWS] = _near(v[own[i : i + ROWS]], v, radius) @ n >= least
        return pa.table([ids.take(pa.array(own)), pa.array(core)], names=["id", "core"])

    cores = checkpointed(dealt.groupBy("cell").applyInArrow(count, StructType([id_field, StructField("core", BooleanType())])))
    flagged = dealt.join(cores, "id")

    def link(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        v, home, ids, _ = _table(part)
        core = part.column("core").to_numpy(zero_copy_only=False)
        a, b, border = [], [], []
        rest = np.flatnonzero(core)
        a.append(rest[home[rest]])  # a core point alone is a cluster too
        b.append(rest[home[rest]])
        border.append(np.zeros(int(home[rest].sum()), bool))
        while len(rest):  # a spanning tree of each group: what is reached is searched no more
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                p = np.array(queue[:ROWS])
                del queue[:ROWS]
                near = _near(v[p], v[rest], radius)
                hit = near.any(0)
                a.append(p[near[:, hit].argmax(0)])
                b.append(rest[hit])
                border.append(np.zeros(int(hit.sum()), bool))
                queue += rest[hit].tolist()
                rest = rest[~hit]
        own, all_cores = np.flatnonzero(home & ~core), np.flatnonzero(core)
        for i in range(0, len(own), ROWS):  # fewer than ``least`` core points each
            x, y = np.nonzero(_near(v[own[i : i + ROWS]], v[all_cores], radius))
            a.append(own[i : i + ROWS][x])
            b.append(all_cores[y])
            border.append(np.ones(len(x), bool))
        take = lambda x: ids.take(pa.array(np.concatenate(x).astype(np.int64)))
        return pa.table([take(a), take(b), pa.array(np.concatenate(border))], names=["a", "b", "border"])

    schema = StructType([StructField("a", id_field.dataType), StructField("b", id_field.dataType), StructField("border", BooleanType())])
    edges = checkpointed(flagged.groupBy("cell").applyInArrow(link, schema))
    inside = connected_components(edges.where(~F.col("border")).select("a", "b"))
    near = edges.where("border").join(inside.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("cluster"))
    return inside.select(F.col("node").alias("id"), F.col("component").alias("cluster")).unionByName(near)


def density_topics(df: DataFrame, key: str, embedding: str, radius: float, least: int = 5, min_size: int = 2, cosine: bool = False, cell: int = CELL) -> DataFrame:
    """(key, topic): topics of dense regions, the largest as 0, ties by their smallest key; outliers are −1.

    The number of topics comes from the data. With ``cosine`` vectors are scaled to length 1, and a radius r means a cosine of 1 − r² / 2.
    Null vectors, those with a null, of another length than most or, for cosines, of length 0, and topics of fewer than ``min_size`` rows are outliers. Equal keys are rows of their own.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = df.select(F.col(key).alias("key"), v.alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    if cosine:
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("v", F.when(sound & (length > 0), F.transform("v", lambda x: x / length)))
    rows = checkpointed(rows)
    first = rows.where(sound).agg(F.mode(F.size("v")).alias("n")).first()["n"]
    given = rows.where(sound & (F.size("v") == F.lit(first or 0)))
    points = checkpointed(given.groupBy("v").agg(F.min("key").alias("id"), F.count("*").alias("n")).where(F.col("id").isNotNull()))
    found = checkpointed(clusters(points, radius, least, cell))
    named = checkpointed(points.join(found, "id", "left"))
    sizes = named.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size)
    order = global_position(sizes, [F.desc("size"), F.asc("cluster")], "_pos").select("cluster", (F.col("_pos") - 1).cast("int").alias("topic"))
    topic_of = named.join(order, "cluster").select("v", "topic")
    joined = given.join(topic_of, "v", "left").select("key", F.coalesce("topic", F.lit(-1)).alias("topic"))
    others = rows.where(~F.coalesce(sound & (F.size("v") == F.lit(first or 0)), F.lit(False))).select("key", F.lit(-1).alias("topic"))
    return joined.unionByName(others).withColumnRenamed("key", key)
