"""Ranked lexical search: an impact-sorted index in shards of documents, read with the NRA method.

Spark counts in how many documents each query term occurs, how many documents and terms there are,
and deals the documents to shards of about ``SHARD`` postings. In a shard each term has a list of
documents sorted by impact, the term's part of the score. A query reads its lists from the top,
and in order only: the score of a document lies between what was read of it and that plus the
last impact read of each list it was not met in. Reading goes on until no other document
can be among the first k, ties included, and the scores of the k are known to the last digit.
The first k of all shards are then the first k of all documents.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType

from textspark.llm.common import arrow_map, query, table, texts, written

SHARD = 3_000_000  # postings a shard is meant to hold; a target, not a cap
BLOCK = 1 << 21  # characters of query texts that go to the tasks at once; further ones go in further blocks
DEPTH = 256  # first read of each list; each further read is twice as long

#: A-Z become a-z; ASCII other than letters and digits parts terms.
MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(MARKS).split()


# ---------------------------------------------------------------- sequential reads


def nra(lists: list[tuple[np.ndarray, np.ndarray]], k: int, size: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best of ``size`` documents, their scores, and the number of postings read.

    Each list has documents and positive impacts, highest impact first. Of equal scores the
    lower document comes first; documents with a score of 0 are none.
    """
    low, met = np.zeros(size, np.int64), np.zeros(size, np.int64)  # met: last impacts read of the lists that have the document
    bottom = [int(x[0]) if len(x) else 0 for _, x in lists]
    at, read = [0] * len(lists), 0
    alive, counts = np.arange(size), np.ones(size, bool)
    while True:
        more = False
        for t, (docs, impacts) in enumerate(lists):
            # a list is read on only while a document that still counts was not met in it
            if not bottom[t] or int(counts[docs[: at[t]]].sum()) == len(alive):
                continue
            to = min(len(docs), at[t] + depth)
            last = int(impacts[to - 1]) if to < len(docs) else 0
            met[docs[: at[t]]] += last - bottom[t]
            met[docs[at[t] : to]] += last
            low[docs[at[t] : to]] += impacts[at[t] : to]
            read, at[t], bottom[t], more = read + to - at[t], to, last, True
        if not more:
            break
        depth *= 2
        high = low[alive] + sum(bottom) - met[alive]
        if len(alive) > k:
            # the k-th best of what is certain; what cannot come before it is done with
            last = alive[np.lexsort((alive, -low[alive]))[k - 1]]
            still = (high > low[last]) | (high == low[last]) & (alive <= last)
            counts[alive[~still]] = False
            alive, high = alive[still], high[still]
        if len(alive) <= k and (low[alive] == high).all():
            break
    best = alive[np.lexsort((alive, -low[alive]))][:k]
    best = best[low[best] > 0]
    return best, low[best], read


class Shard:
    """Impact-sorted lists over the documents of a shard, numbered in the order of their ids, nulls last."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int):
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending")])).combine_chunks()
        self.ids = rows.column("doc_id")
        n = rows.column("n").to_numpy()
        m = 100 - 90 + 90 * n * n_docs // max(1, n_terms)
        sizes = pc.list_value_length(rows.column("slots")).to_numpy()
        docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        slot = pc.list_flatten(rows.column("slots")).to_numpy()
        tf = pc.list_flatten(rows.column("tfs")).to_numpy()
        impact = weights[slot] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
        order = np.lexsort((docs, -impact, slot))
        order = order[impact[order] > 0]
        self.docs, self.impacts, slot = docs[order], impact[order], slot[order]
        self.starts = np.searchsorted(slot, np.arange(len(weights) + 1))

    def search(self, slots: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        lists = [(self.docs[a:b], self.impacts[a:b]) for a, b in ((self.starts[s], self.starts[s + 1]) for s in slots) if b > a]
        return nra(lists, k, len(self.ids))


# ---------------------------------------------------------------- index and search


def postings(docs: DataFrame, slot_of: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, slots, tfs) of the documents with a term: their number of terms and those that ``slot_of`` has."""
    shared = docs.sparkSession.sparkContext.broadcast(slot_of)

    def run(batch):
        get, at, ns, sizes, slots, tfs = shared.value.get, [], [], [], [], []
        for i, t in enumerate(texts(batch.column(1))):
            w = terms(t)
            if w:
                found, tf = np.unique(np.fromiter((s for s in map(get, w) if s is not None), np.int32), return_counts=True)
                at.append(i)
                ns.append(len(w))
                sizes.append(len(found))
                slots.append(found)
                tfs.append(tf)
        ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
        flat = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind)))
        ids = batch.column(0).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), flat(slots, np.int32), flat(tfs, np.int64)], schema.names)

    schema = docs.select("doc_id").schema.add("n", "long").add("slots", ArrayType(IntegerType())).add("tfs", ArrayType(LongType()))
    return arrow_map(docs, run, schema)


def search_block(docs: DataFrame, items: list[tuple], item_type: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the first ``k`` of each shard for each of ``items`` (id, set of terms)."""
    spark = docs.sparkSession
    slot_of = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
    index = written(postings(docs, slot_of), "postings")
    total = index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("slots")), F.lit(0)).alias("all")).first()
    df = np.zeros(len(slot_of), np.int64)
    for r in index.select(F.explode("slots").alias("s")).groupBy("s").count().collect():  # one row a query term of the block
        df[r["s"]] = r["count"]
    n = total["docs"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    slot_lists = [(item, sorted(slot_of[w] for w in words)) for item, words in items]
    shared = spark.sparkContext.broadcast((slot_lists, weights, n, total["terms"]))
    schema = item_type.schema.add(docs.schema["doc_id"]).add("score", "long")
    kind = to_arrow_type(item_type.schema["item_id"].dataType)

    def run(rows: pa.Table) -> pa.Table:
        lists, w, n_docs, n_terms = shared.value
        shard = Shard(rows, w, n_docs, n_terms)
        ids, found, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, slots in lists:
            best, score, _ = shard.search(slots, k)
            ids += [item] * len(best)
            found.append(best)
            scores.append(score)
        return pa.table([pa.array(ids, kind), shard.ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], names=schema.names)

    shards = max(1, math.ceil(total["all"] / SHARD))
    dealt = index.withColumn("_llm_shard", F.pmod(F.xxhash64(*index.columns), F.lit(shards)))
    return dealt.groupBy("_llm_shard").applyInArrow(lambda rows: run(rows.drop_columns(["_llm_shard"])), schema)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Null and empty texts have no terms, match nothing and are not counted. Items with equal ids are
    one item with the terms of all of them; a null id is an id like others. Equal scores go by
    ascending doc_id, null last; repeated rows are documents of their own, in adjacent ranks. Without
    documents or items there are no rows. Further columns are left out.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where(F.length("text") > 0)
    chars = asked.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(chars / BLOCK))
    parts = []
    for b in range(blocks):
        of: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect():  # about BLOCK characters
            of.setdefault(r["item_id"], set()).update(terms(r["text"].encode("utf-8", "replace")))
        of = {i: w for i, w in of.items() if w}
        if of:
            parts.append(search_block(rows, sorted(of.items(), key=lambda x: (x[0] is None, x[0] or 0)), asked.select("item_id"), k))
    schema = asked.select("item_id").schema.add(rows.schema["doc_id"]).add("score", "long")
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


OP11 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
sizes AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY doc_id),
total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
tfs AS (SELECT doc_id, w, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY doc_id, w),
weights AS (
  SELECT w, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM tfs, total GROUP BY w, big_n),
parts AS (
  SELECT a.item_id, t.doc_id, g.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + ((90 * s.n * big_n) // big_l)))) AS part
  FROM asked a JOIN tfs t USING (w) JOIN weights g USING (w) JOIN sizes s USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""


@query("op11_nra_search", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
