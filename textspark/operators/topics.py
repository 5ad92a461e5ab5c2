"""Topic models, and the tables made from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scores import argmax_index
from ..functions.text import word_count
from .corpus import bag_of_words, class_tf_idf, count_vectors, document_frequency, term_rows, tf_idf_l2
from .lda import Blocks as LdaBlocks
from .lda import LdaModel, Packed, heaviest, perplexity, shares
from .lda import blocks_of as lda_blocks
from .lda import fit as fit_lda
from .scale import checkpointed, counted_lookup, dropped, global_position, sized_broadcast, swept, top_k

# ---------------------------------------------------------------- vectors


@dataclass
class TermVectors:
    """Documents and their weighted terms, as rows (key, term, n, weight); the vocabulary stays a table."""

    frame: DataFrame
    key: str
    entries: DataFrame
    _blocks: dict = field(default_factory=dict)

    def blocks(self, weight: str = "weight", least: int = 1) -> LdaBlocks:
        if (weight, least) not in self._blocks:
            rows = self.entries.select(self.key, "term", F.col(weight).cast("double").alias("weight"))
            self._blocks[weight, least] = lda_blocks(rows, self.key, least=least)
        return self._blocks[weight, least]

    def vocab_table(self) -> DataFrame:
        """(term, frequency, termIndex), the most frequent term first."""
        counts = self.entries.groupBy("term").agg(F.sum("n").alias("frequency"))
        ranked = global_position(counts, [F.desc("frequency"), F.asc("term")], "_pos")
        return ranked.select("term", "frequency", (F.col("_pos") - 1).alias("termIndex"))


def term_vectors(df: DataFrame, terms: str, key: str | None = None, vocab_size: int | None = None, min_df: float = 1.0, min_tf: float = 1.0) -> TermVectors:
    """Counts and weights n · ln((N + 1) / (df + 1)) of all terms in at least ``min_df`` documents (a share below 1).

    ``key`` is unique in ``df``; without one the rows are written with numbers.
    """
    if key is None:
        key, df = "_row", checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    n_docs = df.count()
    least = min_df if min_df >= 1 else min_df * n_docs
    bag = checkpointed(count_vectors(df, key, terms, vocab_size, least, min_tf))
    swept(df.sparkSession)
    joined = counted_lookup(bag, document_frequency(bag).select("term", "n_docs"), ["term"], "n_docs", F.col(key))
    weight = F.col("n") * F.log(F.lit(float(n_docs + 1)) / (F.col("n_docs") + 1))
    entries = checkpointed(joined.select(key, "term", "n", weight.alias("weight")))
    dropped(bag)
    swept(df.sparkSession)
    return TermVectors(df, key, entries)


# ---------------------------------------------------------------- LDA


def lda(vectors: TermVectors, k: int = 20, iterations: int = 10, seed: int = 42, online: bool = False, weight: str = "weight") -> LdaModel:
    """k topics of the weighted terms, or of the counts with ``weight="n"``; the online variant takes half of the documents a step and forgets slowly."""
    blocks = vectors.blocks(weight, 2 if online else 1)
    return fit_lda(blocks, k, iterations, seed, batches=2 if online else 1, decay=0.51, offset=1.0)


def topic_cloud(model: LdaModel, n: int = 10) -> DataFrame:
    """(topic, term, weight, rank): the n heaviest terms of every topic."""
    return heaviest(model, n)


def topic_words(model: LdaModel, n: int = 10) -> DataFrame:
    """(topic, topicWords) heaviest first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))  # n entries
    return heaviest(model, n).groupBy("topic").agg(F.transform(ordered, lambda r: r["term"]).alias("topicWords"))


def zip_terms(topics: DataFrame, topic: str, terms: str, weights: str) -> DataFrame:
    """(topic, term, weight): parallel arrays zipped by position, no join; a shorter or missing array of weights gives nulls."""
    given = F.coalesce(F.col(weights), F.array().cast(topics.schema[weights].dataType))
    zipped = F.arrays_zip(F.col(terms).alias("term"), given.alias("weight"))
    return topics.select(topic, F.explode(zipped).alias("z")).select(topic, "z.term", "z.weight")


def assign_topic(model: LdaModel, vectors: TermVectors, weight: str = "weight", out: str = "topicNo") -> DataFrame:
    """The documents with their topic of the largest share, ``probability``; documents without a term are dropped."""
    found = shares(model, vectors.blocks(weight)).select(vectors.key, argmax_index(F.col("v")).alias(out), F.array_max("v").alias("probability"))
    return vectors.frame.join(found, vectors.key)


def topic_scores(model: LdaModel, vectors: TermVectors, text: str) -> DataFrame:
    """(reviewText, topicNo, wordCount)."""
    rows = assign_topic(model, vectors)
    return rows.select(F.col(text).alias("reviewText"), "topicNo", word_count(F.col(text)).alias("wordCount"))


def auto_topics(vectors: TermVectors, iterations: int = 10, seed: int = 42, gain: float = 0.02, held: int = 5, weight: str = "n", most: int = 512) -> tuple[LdaModel, DataFrame]:
    """The number of topics from the data: (model, topics that got documents with their doc_count).

    One in ``held`` documents, by the hash of its key, is kept back. The number doubles while that lowers the
    perplexity of those documents by the share ``gain``, up to ``most``; then the smallest number between the last two is searched
    for that is within ``gain`` of the best. The model of that number is fitted on all documents.
    """
    rows = vectors.entries.select(vectors.key, "term", F.col(weight).cast("double").alias("weight"))
    back = F.pmod(F.xxhash64(F.lit(seed), vectors.key), F.lit(held)) == 0
    train, test = lda_blocks(rows.where(~back), vectors.key), lda_blocks(rows.where(back), vectors.key)
    seen: dict[int, float] = {}

    def score(k: int) -> float:
        if k not in seen:
            model = fit_lda(train, k, iterations, seed, track=False)
            seen[k] = perplexity(model, test)
            dropped(model.weights)
        return seen[k]

    low, high = 1, 2
    while high < most and score(2 * high) < score(high) * (1 - gain):
        low, high = high, 2 * high
    if low == 1 and not score(2) < score(1) * (1 - gain):
        high = 1
    good = score(high) * (1 + gain)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if score(middle) <= good else (middle, high)
    dropped(train.packed, train.terms, test.packed, test.terms)
    model = lda(vectors, high, iterations, seed, weight=weight)
    sizes = assign_topic(model, vectors, weight).groupBy("topicNo").agg(F.count("*").alias("doc_count"))
    return model, sizes


# ---------------------------------------------------------------- LSI, NMF


FREQUENT = 1 << 23  # entries of a block times numbers of a term; the documents of a more frequent term are in several blocks


def _seeded(term: Column, i: int, seed: int) -> Column:
    """A number in [-1, 1) that depends on the term, the column and the seed only."""
    return F.xxhash64(term, F.lit(i), F.lit(seed)) / F.lit(float(1 << 63))


def _blocks(entries: DataFrame, key: str, width: int) -> LdaBlocks:
    """Blocks of (key, term, weight) for vectors of ``width`` numbers; rows without a key are left out, as by a join."""
    return lda_blocks(entries.where(F.col(key).isNotNull()), key, size=max(1, FREQUENT // width))


def _in_blocks(packed: DataFrame, blocks: LdaBlocks, by: DataFrame, width: int, use, schema) -> DataFrame:
    """``use(packed row, Packed)`` as a table, for each block with the vectors (term, v) of its terms; a term without one has zeros.

    A term comes once to each block, however many documents have it, and the blocks come to the task as they are.
    """
    known = blocks.terms.join(by.repartition(blocks.shards, "term"), "term", "left").select("block", "pos", "term", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("pos", "ascending")])).combine_chunks()
        lists = right.column("v").chunk(0)
        vectors = np.zeros((len(lists), width))
        vectors[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy().reshape(-1, width)
        return use(left, Packed(left, vectors), right.column("term").chunk(0))

    return packed.groupBy("block").cogroup(blocks.by_lane(known).groupBy("block")).applyInArrow(run, schema)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _summed(found: DataFrame, name: str, width: int, by: str | None = None) -> DataFrame:
    """Sums of the arrays ``name``, summed in the task first."""
    sums = F.array(*[F.sum(F.get(name, i)) for i in range(width)]).alias("v")
    return found.agg(sums) if by is None else found.where(F.col(by).isNotNull()).groupBy(by).agg(sums)


def _square(found: DataFrame, name: str, k: int) -> np.ndarray:
    """The k x k sums of the arrays ``name``, zeros where there is none."""
    return np.array([x or 0.0 for x in _summed(found, name, k * k).first()["v"]]).reshape(k, k)


def _gram(vectors: DataFrame, k: int) -> np.ndarray:
    """k x k products of the columns of (id, v)."""
    x = [F.get("v", i) for i in range(k)]
    row = vectors.agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def _turned(vectors: DataFrame, name: str, by: np.ndarray) -> DataFrame:
    """(id, v) times a small matrix."""
    new = [sum((F.get("v", i) * float(by[i, j]) for i in range(by.shape[0])), F.lit(0.0)) for j in range(by.shape[1])]
    return vectors.select(name, F.array(*new).alias("v"))


def lsi(df: DataFrame, key: str, tokens: str, k: int = 5, n: int = 10, iterations: int = 6, extra: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(topics, documents) by a truncated SVD of the term counts; a document's topic has the largest absolute weight.

    Subspace iteration with ``extra`` further directions over blocks of documents: each
    round takes the vectors of the terms to the blocks that have them and sums what the documents of a block
    send back, first in the block; only k x k products come to the driver. It starts from hashes
    of the terms and the heaviest term of a topic has a positive weight, so neither partitions
    nor the order of rows matter.
    """
    bag = checkpointed(bag_of_words(df, key, tokens).select(key, "term", F.col("n").cast("double").alias("weight")))
    width = k + extra
    blocks = _blocks(bag, key, width)
    basis = bag.select("term").distinct().select("term", F.array(*[_seeded(F.col("term"), i, seed) for i in range(width)]).alias("v"))

    def back(_row: pa.Table, block: Packed, term: pa.Array) -> pa.Table:
        return pa.table({"term": term, "s": _lists(block.by_term(block.by_document(block.beta)))})

    def gram(_row: pa.Table, block: Packed, _term: pa.Array) -> pa.Table:
        own = block.by_document(block.beta)
        return pa.table({"g": _lists((own.T @ own).reshape(1, -1))})

    image = None
    for _ in range(iterations):
        found = _in_blocks(blocks.packed, blocks, basis, width, back, "term string, s array<double>")
        last, image = image, checkpointed(_summed(found, "s", width, "term"))
        dropped(*[x for x in (last,) if x is not None])
        swept(df.sparkSession)
        values, turn = np.linalg.eigh(_gram(image, width))
        safe = values > values.max(initial=0.0) * 1e-12
        basis = _turned(image, "term", np.where(safe, turn / np.sqrt(np.where(safe, values, 1.0)), 0.0))
    basis = checkpointed(basis)
    values, turn = np.linalg.eigh(_square(_in_blocks(blocks.packed, blocks, basis, width, gram, "g array<double>"), "g", width))
    basis = checkpointed(_turned(basis, "term", turn[:, np.argsort(-values)[:k]]))
    heavy = basis.select("term", F.posexplode("v").alias("topic", "w")).withColumn("score", F.abs("w"))
    best = top_k(heavy, ["topic"], [F.desc(F.round("score", 9)), F.asc("term")], n).select("topic", "term", "score", "rank")
    schema = StructType([blocks.key_field, StructField("v", ArrayType(DoubleType()))])
    names = schema.names

    def own(_row: pa.Table, block: Packed, _term: pa.Array) -> pa.Table:
        return pa.table([block.keys, _lists(block.by_document(block.beta))], names=names)

    sums = _in_blocks(blocks.packed, blocks, basis, k, own, schema)
    share = F.transform("v", lambda x: F.abs(x))
    docs = sums.select(key, argmax_index(share).alias("topic"), F.array_max(share).alias("probability"))
    everyone = df.select(key).join(docs, key, "left")
    return best, everyone.select(key, F.coalesce("topic", F.lit(0)).alias("topic"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def nmf(df: DataFrame, key: str, tokens: str, k: int = 5, iterations: int = 20, seed: int = 42, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(topics, documents) by a non-negative factorisation of the TF-IDF entries, absent ones as zeros.

    Multiplicative updates over blocks of documents: a round takes the vectors of the terms to the blocks, where the documents
    are updated, and sums what these say of each term; the k x k products alone come to the driver.
    Keys may be of any type. A document's share is w / sum of w.
    """
    weights = checkpointed(tf_idf_l2(df, key, tokens, top=top))
    blocks = _blocks(weights, key, k)
    positive = lambda c, i: F.abs(_seeded(c, i, seed)) + 0.1
    seeds = F.flatten(F.transform("keys", lambda c: F.array(*[positive(c, i) for i in range(k)])))
    left = blocks.packed.select("block", seeds.alias("left"))
    right = checkpointed(blocks.terms.select("term").distinct().select("term", F.array(*[positive(F.col("term"), i) for i in range(k)]).alias("v")))
    schema = "block long, left array<double>, term string, s array<double>, g array<double>"

    def updated(gram: np.ndarray):
        """The new vectors of a block's documents, their products, and their part in each term."""

        def use(row: pa.Table, block: Packed, term: pa.Array) -> pa.Table:
            old = row.column("left").combine_chunks().flatten().to_numpy().reshape(-1, k)
            new = old * block.by_document(block.beta) / (old @ gram + 1e-12)
            none, lists = len(term), pa.list_(pa.float64())
            return pa.table({
                "block": pa.concat_arrays([row.column("block").combine_chunks()[:1], pa.nulls(none, pa.int64())]),
                "left": pa.concat_arrays([_lists(new.reshape(1, -1)), pa.nulls(none, lists)]),
                "term": pa.concat_arrays([pa.nulls(1, pa.string()), term]),
                "s": pa.concat_arrays([pa.nulls(1, lists), _lists(block.by_term(new))]),
                "g": pa.concat_arrays([_lists((new.T @ new).reshape(1, -1)), pa.nulls(none, lists)]),
            })

        return use

    before = None
    for _ in range(iterations):
        # the vectors of a block's documents are one row
        found = checkpointed(_in_blocks(blocks.packed.join(blocks.by_lane(left), "block"), blocks, right, k, updated(_gram(right, k)), schema))
        left, gram = found.where(F.col("block").isNotNull()).select("block", "left"), _square(found, "g", k)
        target = _summed(found, "s", k, "term").withColumnRenamed("v", "target")
        below = [sum((F.get("v", i) * float(gram[i, j]) for i in range(k)), F.lit(1e-12)) for j in range(k)]
        new = F.array(*[F.get("v", j) * F.get("target", j) / below[j] for j in range(k)])
        old, right = right, checkpointed(right.join(target, "term").select("term", new.alias("v")))
        dropped(old, *([] if before is None else [before]))
        swept(df.sparkSession)
        before = found  # has the vectors of the documents
    rows = right.select("term", F.posexplode("v").alias("topic", "score"))
    topics = top_k(rows, ["topic"], [F.desc(F.round("score", 9)), F.asc("term")], 10).select("topic", "term", "score", "rank")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    listed = blocks.packed.select("block", "keys").join(blocks.by_lane(left), "block").select(F.posexplode("keys").alias("_at", key), "left")
    rows = listed.select(key, F.slice("left", F.col("_at") * k + 1, F.lit(k)).alias("v"))
    docs = rows.select(key, argmax_index(F.col("v")).alias("topic"), F.when(total > 0, F.array_max("v") / total).otherwise(0.0).alias("probability"))
    return topics, docs


# ---------------------------------------------------------------- clusters of embeddings


def embedding_topics(df: DataFrame, key: str, embedding: str, k: int, dims: int = 5, seed: int = 42, min_size: int = 2, bisecting: bool = False) -> DataFrame:
    """(key, topic): reduced embeddings clustered; clusters smaller than ``min_size`` become −1."""
    vectors = df.select(key, array_to_vector(F.transform(F.col(embedding), lambda x: x.cast("double"))).alias("v"))
    reduced = PCA(k=dims, inputCol="v", outputCol="r").fit(vectors).transform(vectors)
    algorithm = BisectingKMeans(k=k, seed=seed, featuresCol="r") if bisecting else KMeans(k=k, seed=seed, featuresCol="r")
    clustered = algorithm.fit(reduced).transform(reduced).select(key, F.col("prediction").alias("_c"))
    sizes = clustered.groupBy("_c").agg(F.count("*").alias("_n"))  # k rows
    return clustered.join(F.broadcast(sizes), "_c").select(key, F.when(F.col("_n") >= min_size, F.col("_c")).otherwise(-1).alias("topic"))


def topic_info(assigned: DataFrame, topic: str, tokens: str, n: int = 10) -> DataFrame:
    """(topic, keywords, scores, doc_count, outliers): best terms by class TF-IDF, outliers (−1) counted apart."""
    inliers = assigned.filter(F.col(topic) != -1)
    best = top_k(class_tf_idf(inliers, topic, tokens), [topic], [F.desc("weight"), F.asc("term")], n)
    pair = F.array_sort(F.collect_list(F.struct("rank", "term", "weight")))
    words = best.groupBy(topic).agg(pair.alias("_w")).select(
        topic, F.transform("_w", lambda w: w["term"]).alias("keywords"), F.transform("_w", lambda w: w["weight"]).alias("scores")
    )
    from .corpus import topic_sizes

    return topic_sizes(assigned, topic).join(words, topic, "left").select(topic, "keywords", "scores", "doc_count", "outliers")


def doc_topics(docs: DataFrame, topics: DataFrame, topic: str, n: int = 5) -> DataFrame:
    """Documents with the first n keywords of their topic; outliers have none."""
    named = topics.select(topic, F.slice("keywords", 1, n).alias("topic_keywords"))
    joined = docs.join(sized_broadcast(named), topic, "left")
    return joined.withColumn("topic_keywords", F.coalesce("topic_keywords", F.array().cast("array<string>")))


def centroids(df: DataFrame, topic: str, embedding: str, dims: int) -> DataFrame:
    """(topic, n, v): mean embedding per topic, summed inside each task first."""
    parts = [F.avg(F.get(F.col(embedding), i).cast("double")) for i in range(dims)]
    return df.groupBy(topic).agg(F.count("*").alias("n"), F.array(*parts).alias("v"))


def topic_similarity(vectors: DataFrame, topic: str) -> DataFrame:
    """(a, b, cosine) of every pair of topics: joined on the component, summed per pair."""
    parts = vectors.select(topic, F.posexplode("v").alias("i", "x"))
    length = parts.groupBy(topic).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    one = parts.join(length, topic).select(F.col(topic).alias("a"), "i", (F.col("x") / F.col("length")).alias("x"))
    two = one.select(F.col("a").alias("b"), "i", F.col("x").alias("y"))
    return one.join(two, "i").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def topic_map(vectors: DataFrame, topic: str) -> DataFrame:
    """(topic, n, x, y): topics in the plane of the two main components."""
    points = vectors.select(topic, "n", array_to_vector("v").alias("p"))
    flat = PCA(k=2, inputCol="p", outputCol="xy").fit(points).transform(points).withColumn("xy", vector_to_array("xy"))
    return flat.select(topic, "n", F.get("xy", 0).alias("x"), F.get("xy", 1).alias("y"))


def topic_relevance(df: DataFrame, topic: str, tokens: str, weight: float = 0.6) -> DataFrame:
    """(topic, term, n, p_term_topic, p_term, prevalence, relevance) with λ·ln p(w|t) + (1 − λ)·ln (p(w|t) / p(w)) (LDAvis)."""
    counts = checkpointed(term_rows(df, tokens, [topic]).groupBy(topic, "term").agg(F.count("*").alias("n")))
    per_topic = counts.groupBy(topic).agg(F.sum("n").alias("_topic"))
    per_term = counts.groupBy("term").agg(F.sum("n").alias("_term"), F.count("*").alias("_topics"))
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    joined = counted_lookup(counts, per_term, ["term"], "_topics", F.col(topic)).join(sized_broadcast(per_topic), topic)
    p_tt, p_t = F.col("n") / F.col("_topic"), F.col("_term") / F.lit(float(total or 1))
    return joined.select(
        topic, "term", "n", p_tt.alias("p_term_topic"), p_t.alias("p_term"), (F.col("_topic") / F.lit(float(total or 1))).alias("prevalence"),
        (F.lit(weight) * F.log(p_tt) + F.lit(1 - weight) * F.log(p_tt / p_t)).alias("relevance"),
    )
