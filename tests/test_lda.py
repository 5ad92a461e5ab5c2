"""Topic models over tables: planted themes, rising bounds, no dependence on partitions."""

import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textspark.operators import lda, scale, topics


def planted(spark, k, n_docs, seed=1, words=30):
    rng = random.Random(seed)
    themes = [[f"t{j}_{i}" for i in range(12)] for j in range(k)]
    rows = [(d, [rng.choice(themes[d % k]) for _ in range(words)], "x") for d in range(n_docs)]
    return spark.createDataFrame(rows, "id long, tokens array<string>, term string")


def entries(df):
    return df.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))


def test_special_functions():
    x = np.array([1e-3, 0.02, 0.3, 1.0, 1.5, 2.5, 6.0, 7.0, 50.0, 1e6])
    assert lda.log_gamma(x) == pytest.approx([math.lgamma(a) for a in x], rel=1e-10, abs=1e-10)
    slope = (lda.log_gamma(x * (1 + 1e-5)) - lda.log_gamma(x * (1 - 1e-5))) / (2e-5 * x)
    assert lda.digamma(x) == pytest.approx(slope, rel=1e-4, abs=1e-4)
    assert lda.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649, -1.9635100260], abs=1e-9)


def plain_step(counts, weights, alpha, eta):
    """One batch step in numpy over a dense matrix (documents, terms)."""
    beta = np.exp(lda.digamma(weights) - lda.digamma(weights.sum(0)))
    out = np.zeros_like(weights)
    for row in counts:
        gamma = np.ones(weights.shape[1])
        for _ in range(2000):
            theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
            new = alpha + theta * ((row / (beta @ theta + 1e-100)) @ beta)
            done, gamma = np.abs(new - gamma).max() < 1e-12, new
            if done:
                break
        theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
        out += beta * ((row / (beta @ theta + 1e-100))[:, None] * theta)
    return out + eta


def test_a_step_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(lda, "CLOSE", 1e-12)
    monkeypatch.setattr(lda, "INNER", 2000)
    df = entries(planted(spark, 2, 12, words=8))
    rows = df.collect()
    terms = sorted({r["term"] for r in rows})
    counts = np.zeros((12, len(terms)))
    for r in rows:
        counts[r["id"], terms.index(r["term"])] = r["weight"]
    blocks = lda.blocks_of(df, "id", size=40)
    assert blocks.count > 1 and blocks.documents == 12
    before = lda.started(blocks, 3, None, None, 42)
    of = lambda m: np.array([v for _, v in sorted((r["term"], r["v"]) for r in m.weights.collect())])
    first = of(before)
    after = lda.step(before, blocks)
    assert after.totals == pytest.approx(of(after).sum(0))
    # workers import the module anew, so their inner loop ends at its own bound
    assert of(after) == pytest.approx(plain_step(counts, first, 1 / 3, 1 / 3), abs=2e-2)


def test_fitted_documents_take_no_more_steps(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [np.sort(rng.choice(40, n, replace=False)) for n in (1, 2, 1, 3, 30, 2, 25)]
    block = lda.Packed.__new__(lda.Packed)
    block.doc, block.term = np.repeat(np.arange(7), [len(d) for d in docs]).astype(np.int32), np.concatenate(docs).astype(np.int32)
    block.weight, block.beta, block.keys = rng.uniform(0.1, 3, len(block.doc)), rng.dirichlet(np.ones(40), 4).T, range(7)
    block.starts = np.searchsorted(block.doc, np.arange(7))
    gamma = np.ones((7, 4))
    for _ in range(lda.INNER):
        theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum(1))[:, None])
        norm = (theta[block.doc] * block.beta[block.term]).sum(1) + lda.TINY
        new = 0.2 + theta * np.add.reduceat(block.beta[block.term] * (block.weight / norm)[:, None], block.starts)
        change, gamma = np.abs(new - gamma).mean(1).max(), new
        if change < lda.CLOSE:
            break
    taken, plain = [], lda.digamma
    monkeypatch.setattr(lda, "CLOSE", 2e-11)
    monkeypatch.setattr(lda, "INNER", 5000)
    monkeypatch.setattr(lda, "digamma", lambda x: taken.append(len(x)) or plain(x))
    every, _, _ = block.fit(0.2)
    assert min(taken) < 7  # fitted ones are left out
    monkeypatch.undo()
    found, log_theta, norm = block.fit(0.2)
    assert found == pytest.approx(gamma, abs=1e-9)
    assert every.sum(1) == pytest.approx(gamma.sum(1))
    assert norm == pytest.approx((np.exp(log_theta)[block.doc] * block.beta[block.term]).sum(1))


def test_partitions_do_not_matter(spark):
    df = entries(planted(spark, 3, 60))
    found = []
    for n in (1, 3, 7):
        blocks = lda.blocks_of(df.repartition(n, "term"), "id", size=150)
        model = lda.fit(blocks, 3, 3)
        found.append((model.bounds, sorted((r["topic"], r["rank"], r["term"], round(r["weight"], 9)) for r in lda.heaviest(model, 5).collect())))
    for bounds, rows in found[1:]:
        assert bounds == pytest.approx(found[0][0], rel=1e-9) and rows == found[0][1]


@pytest.mark.parametrize("batches", [1, 2])
def test_themes_are_found(spark, batches):
    df = entries(planted(spark, 3, 90))
    blocks = lda.blocks_of(df, "id", size=300, least=batches)
    model = lda.fit(blocks, 3, 6 * batches, batches=batches)
    words = {frozenset(t[: t.index("_")] for t in r["topicWords"]) for r in topics.topic_words(model, 10).collect()}
    assert words == {frozenset(["t0"]), frozenset(["t1"]), frozenset(["t2"])}
    got = {r["id"]: int(np.argmax(r["v"])) for r in lda.shares(model, blocks).collect()}
    assert len(got) == 90 and all(len({got[d] for d in range(j, 90, 3)}) == 1 for j in range(3))
    if batches == 1:
        assert all(b >= a - 1e-9 * abs(a) for a, b in zip(model.bounds, model.bounds[1:], strict=False)) and len(model.bounds) == 6


@pytest.mark.parametrize("themes", [3, 7])
def test_the_number_of_topics_comes_from_the_data(spark, themes):
    vectors = topics.term_vectors(planted(spark, themes, 40 * themes, words=40), "tokens", "id")
    model, sizes = topics.auto_topics(vectors, iterations=6)
    assert sizes.count() == themes and sizes.agg(F.sum("doc_count")).first()[0] == 40 * themes
    assert model.k >= themes


def test_odd_rows(spark):
    rows = [(1, "a", 1.0), (1, "a", 2.0), (None, "b", 1.0), (2, None, 1.0), (3, "c", 0.0)]
    df = spark.createDataFrame(rows, "id long, term string, weight double")
    blocks = lda.blocks_of(df, "id")
    model = lda.fit(blocks, 2, 2)
    assert sorted((r["id"] is None, r["id"]) for r in lda.shares(model, blocks).collect()) == [(False, 1), (False, 3), (True, None)]
    none = lda.blocks_of(df.limit(0), "id")
    model = lda.fit(none, 2, 2)
    assert lda.shares(model, none).collect() == [] and lda.heaviest(model).collect() == [] and lda.perplexity(model, none) == math.inf
    other = lda.blocks_of(spark.createDataFrame([(9, "unseen", 1.0)], df.schema), "id")
    assert sum(lda.shares(lda.fit(blocks, 2, 2), other).first()["v"]) == pytest.approx(1)


def test_vectors_keep_the_vocabulary_in_a_table(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, None)], "id long, tokens array<string>")
    v = topics.term_vectors(df, "tokens", "id")
    assert {(r["id"], r["term"]): round(r["weight"], 6) for r in v.entries.collect()} == {(1, "a"): round(2 * math.log(4 / 3), 6), (1, "b"): round(math.log(2), 6), (2, "a"): round(math.log(4 / 3), 6), (2, "c"): round(math.log(2), 6)}
    assert [(r["term"], r["termIndex"]) for r in v.vocab_table().orderBy("termIndex").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    half = topics.term_vectors(df, "tokens", min_df=0.5)
    assert {r["term"] for r in half.entries.collect()} == {"a"}


def tables_kept(spark):
    folder = pathlib.Path(scale.shared_folder(spark).removeprefix("file:"))
    return {p.name for p in folder.iterdir() if p.name.startswith(("table-", "buckets_"))} if folder.is_dir() else set()


def test_lanes_do_not_matter_and_documents_stay_where_they_are(spark, monkeypatch):
    df = entries(planted(spark, 3, 60))
    found = []
    for lane, least in ((1 << 21, 1), (60, 1), (60, 3)):
        monkeypatch.setattr(lda, "LANE", lane)
        blocks = lda.blocks_of(df, "id", size=100, least=least)
        model = lda.fit(blocks, 3, 2)
        found.append((model.bounds, [(r["topic"], r["term"], round(r["weight"], 9)) for r in lda.heaviest(model, 5).orderBy("topic", "rank").collect()]))
        plan = lda._by_block(model, blocks, None, "x long")._jdf.queryExecution().executedPlan().toString()
        assert blocks.lanes > 1 and plan.count("Exchange hashpartitioning") == 1  # the weights go to the lanes, nothing else moves
        assert {r["n"] for r in blocks.packed.groupBy("block").agg(F.count("*").alias("n")).collect()} == {1}
    for bounds, rows in found[1:]:
        assert bounds == pytest.approx(found[0][0], rel=1e-9) and rows == found[0][1]


def test_batches_need_not_be_those_of_the_lanes(spark):
    df = entries(planted(spark, 2, 40))
    rows = []
    for least in (2, 3):  # blocks of 6 numbers both times; lanes have one number modulo 3, which says nothing of those modulo 2
        blocks = lda.blocks_of(df, "id", size=math.ceil(df.count() / 6), least=least)
        assert blocks.count == 6
        model = lda.fit(blocks, 2, 4, batches=2)
        rows.append({r["term"]: r["v"] for r in model.weights.collect()})
    assert rows[0].keys() == rows[1].keys() and all(rows[0][t] == pytest.approx(v) for t, v in rows[1].items())


def test_a_fit_keeps_the_last_weights_only(spark):
    blocks = lda.blocks_of(entries(planted(spark, 2, 20)), "id")
    before = tables_kept(spark)
    model = lda.fit(blocks, 2, 3)
    assert len(tables_kept(spark) - before) == 1 and before <= tables_kept(spark)
    assert model.weights.count() == 24


def test_repeated_and_null_weights_add_up(spark):
    rows = [(1, "a", 1.0), (1, "a", 2.0), (1, "b", None), (1, "b", 4.0), (None, "a", 1.0), (None, "a", 1.0), (2, None, 1.0), (3, "c", 0.5)]
    blocks = lda.blocks_of(spark.createDataFrame(rows, "id long, term string, weight double"), "id", size=2)
    found = {}
    terms = {(r["block"], r["pos"]): r["term"] for r in blocks.terms.collect()}
    for r in blocks.packed.collect():
        doc, term, weight = np.frombuffer(r["doc"], np.int32), np.frombuffer(r["term"], np.int32), np.frombuffer(r["weight"], np.float64)
        assert sum(r["documents"]) == len(r["keys"])
        found |= {(r["keys"][d], terms[r["block"], t]): w for d, t, w in zip(doc, term, weight, strict=True)}
    assert found == {(1, "a"): 3.0, (1, "b"): 4.0, (None, "a"): 2.0, (3, "c"): 0.5} and blocks.documents == 3


@pytest.mark.parametrize("kind", ["string", "int"])
def test_a_large_dictionary_is_joined_by_the_key_alone(spark, monkeypatch, kind):
    fact = spark.createDataFrame([(i, str(i % 7) if i % 11 else None) for i in range(200)], "id long, term string").withColumn("term", F.col("term").cast(kind))
    dim = spark.createDataFrame([(str(i), 200 // 7, float(i)) for i in range(6)], "term string, n long, x double")
    want = fact.join(dim.withColumn("term", F.col("term").cast(kind)), "term", "left").select("id", "term", "n", "x")
    monkeypatch.setattr(scale, "fits", lambda *_: False)
    for hot in (1, 1000):
        got = scale.counted_lookup(fact, dim, ["term"], "n", F.col("id"), hot)
        assert got.columns == ["id", "term", "n", "x"] and got.schema["term"].dataType == fact.schema["term"].dataType
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
