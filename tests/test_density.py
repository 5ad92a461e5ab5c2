"""Density topics and connected components against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textspark.operators import density, graph


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["random", "path", "star", "shuffled path", "loops"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 200
    if shape == "random":
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(130)] + [(None, 5), (7, None)]
    elif shape == "path":
        edges = [(i, i + 1) for i in range(n)]
    elif shape == "star":
        edges = [(500, i) for i in range(n)]
    elif shape == "loops":
        edges = [(i, i) for i in range(5)] + [(3, 4), (4, 3)]
    else:
        order = list(range(n))
        rng.shuffle(order)
        edges = list(zip(order, order[1:], strict=False))
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == plain_components(edges) and len(got) == len(plain_components(edges))


def plain(rows, radius, least, min_size=2):
    """{key: topic} over all pairs."""
    rows = [(k, np.array(v, float)) for k, v in rows]
    near = [[j for j, (_, w) in enumerate(rows) if np.sqrt(((v - w) ** 2).sum()) <= radius] for _, v in rows]
    core = [len(x) >= least for x in near]
    cluster = {}
    for i in sorted((i for i in range(len(rows)) if core[i]), key=lambda i: rows[i][0]):
        if i not in cluster:
            queue = [i]
            cluster[i] = rows[i][0]
            while queue:
                for j in near[queue.pop()]:
                    if core[j] and j not in cluster:
                        cluster[j] = rows[i][0]
                        queue.append(j)
    for i in range(len(rows)):
        if not core[i] and any(core[j] for j in near[i]):
            cluster[i] = min(cluster[j] for j in near[i] if core[j])
    sizes = {}
    for c in cluster.values():
        sizes[c] = sizes.get(c, 0) + 1
    order = {c: t for t, c in enumerate(sorted((c for c in sizes if sizes[c] >= min_size), key=lambda c: (-sizes[c], c)))}
    return {k: order.get(cluster.get(i), -1) for i, (k, _) in enumerate(rows)}


def vectors(n=500, dims=8, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (6, dims))
    rows = [(int(i), (centres[i % 7] if i % 7 < 6 else rng.normal(0, 4, dims)) + rng.normal(0, 0.35, dims)) for i in range(n)]
    chain = [(1000 + i, np.r_[20 + 0.6 * i, np.zeros(dims - 1)]) for i in range(40)]  # long and thin, over many cells
    return [(k, [float(x) for x in v]) for k, v in rows + chain]


@pytest.mark.parametrize("cell", [4000, 60, 12])
def test_topics_equal_a_plain_version(spark, cell):
    rows = vectors()
    rows += [(2000 + i, rows[3][1]) for i in range(9)]  # equal vectors
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    got = density.density_topics(df, "id", "e", 1.3, 5, cell=cell).collect()
    want = plain(rows, 1.3, 5)
    assert {r["id"]: r["topic"] for r in got} == want and len(got) == len(rows)
    assert len(set(want.values())) >= 7 and -1 in want.values()


def test_cosine_and_odd_rows(spark):
    rows = [(i, [1.0 + 0.01 * i, 1.0]) for i in range(6)] + [(10 + i, [-2.0, 5.0 + 0.1 * i]) for i in range(5)]
    odd = [(20, None), (21, []), (22, [1.0, None]), (23, [0.0, 0.0]), (24, [1.0, 1.0, 1.0]), (25, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows + odd, "id long, e array<double>")
    got = {r["id"]: r["topic"] for r in density.density_topics(df, "id", "e", 0.1, 3, cosine=True).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{10 + i: 1 for i in range(5)}, **{k: -1 for k, _ in odd}}
    assert density.density_topics(df.limit(0), "id", "e", 0.1).collect() == []
    few = density.density_topics(df.where("id < 20"), "id", "e", 0.1, 3, min_size=6, cosine=True)
    assert few.groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic").collect() == [(-1, 5), (0, 6)]
