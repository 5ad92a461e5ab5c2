"""Unsupervised keywords (YAKE, Campos et al. 2020) and keyword tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.expr import let
from ..resources import values as V
from .scale import top_k


SENTENCE = r"(?s)(?=\S).*?(?:[.!?](?=\s)|\z)"
SLICE_WORDS = 300_000


def _word_arrays(text: Column) -> Column:
    """What the words of a text are told by: low, size, case (1: capital, 2: acronym), and the lengths between words, of and between sentences."""
    lengths = lambda parts: F.transform(parts, lambda p: F.length(p))

    def of(words: Column) -> Column:
        acronym = lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1)
        return F.struct(
            F.transform(words, lambda w: F.lower(w)).alias("low"),
            lengths(words).alias("size"),
            F.transform(words, lambda w: w.rlike(r"^\p{Lu}").cast("int") + F.when(acronym(w), 2).otherwise(0)).alias("case"),
            lengths(F.split(text, T.WORD, -1)).alias("gap"),
            lengths(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))).alias("sentence"),
            lengths(F.split(text, SENTENCE, -1)).alias("between"),
        )

    return let(F.regexp_extract_all(text, F.lit(T.WORD), F.lit(0)), of)


class _Words:
    """The words of a slice of documents as numpy columns, in text order: doc, part (text and sentence), sentence, i, start, end, code, case."""

    def __init__(self, texts: pa.ListArray):
        per_doc = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
        fields = dict(zip([f.name for f in texts.type.value_type], texts.flatten().flatten(), strict=True))
        flat = {c: fields[c].flatten() for c in fields}
        n = pc.list_value_length(fields["low"]).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(n)), n)
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)[text]
        low = flat["low"].dictionary_encode()
        self.terms, self.code = low.dictionary, low.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.case = flat["case"].to_numpy(zero_copy_only=False)
        size = flat["size"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = self._starts(n, size, flat["gap"])[0]
        self.end = self.start + size
        # sentences end before the next begins, so a word is in the last one that begins at or before it
        m = pc.list_value_length(fields["sentence"]).to_numpy(zero_copy_only=False).astype(np.int64)
        begins, of_text = self._starts(m, flat["sentence"].to_numpy(zero_copy_only=False).astype(np.int64), flat["between"])
        width = max(int(self.end.max(initial=0)), int(begins.max(initial=0))) + 1
        self.part = np.searchsorted(of_text * width + begins, text * width + self.start, side="right") - 1
        self.sentence = self.part - (np.cumsum(m) - m)[text]
        first = np.flatnonzero(np.diff(self.part, prepend=-1))
        self.i = np.arange(len(text)) - np.repeat(first, np.diff(first, append=len(text)))

    @staticmethod
    def _starts(n: np.ndarray, size: np.ndarray, gaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of pieces that alternate with gaps, one gap more than pieces in each text; and the text of each piece."""
        text = np.repeat(np.arange(len(n)), n)
        gap = np.delete(gaps.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n + 1) - 1)
        total = np.cumsum(gap + size)
        before = np.append(0, total)[np.cumsum(n) - n]
        return total - size - before[text], text


def _weights(w: _Words, usable: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, weight of each term): lower means more relevant in its document; NaN where the term is not usable.

    Casing, position, frequency, relatedness to context (in the sentence) and spread over sentences.
    """
    codes = max(len(w.terms), 1)
    keys, term = np.unique(w.doc * codes + w.code, return_inverse=True)
    count, doc, ok = len(keys), keys // codes, usable[keys % codes]
    tf = np.bincount(term, minlength=count)
    tally = lambda mask: np.bincount(term[mask], minlength=count)
    case = np.maximum(tally((w.case & 1 > 0) & (w.i > 0)), tally(w.case & 2 > 0)) / (1 + np.log(tf))

    spread = np.zeros(count)
    for left in (True, False):
        pairs = []
        for d in range(1, min(window, len(term) - 1) + 1):
            near = np.flatnonzero(w.part[d:] == w.part[:-d])
            own, other = (near + d, near) if left else (near, near + d)
            pairs.append(term[own] * codes + w.code[other])
        pairs = np.sort(np.concatenate(pairs or [np.zeros(0, np.int64)]))
        different = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
        all_of, distinct = (np.bincount(x // codes, minlength=count) for x in (pairs, different))
        spread += distinct / np.maximum(all_of, 1)

    order = np.lexsort((w.sentence, term))
    ranked, first = w.sentence[order], np.cumsum(tf) - tf
    median = (ranked[first + (tf - 1) // 2] + ranked[first + tf // 2]) / 2
    fresh = np.append(True, (np.diff(ranked) != 0) | (np.diff(term[order]) != 0))
    found_in = np.bincount(term[order][fresh], minlength=count)

    docs = int(doc.max()) + 1
    n, total, square = (np.bincount(doc[ok], weights=x[ok], minlength=docs) for x in (np.ones(count), tf, tf * tf))
    n = np.maximum(n, 1)
    usual = total / n + np.sqrt(np.maximum(n * square - total * total, 0)) / n
    top, sentences = np.zeros(docs), np.zeros(docs)
    np.maximum.at(top, doc, tf)
    np.maximum.at(sentences, w.doc, w.sentence + 1)
    related = 1 + spread * tf / top[doc]
    with np.errstate(divide="ignore"):
        frequency = tf / usual[doc]
    weight = related * np.log(np.log(3.0 + median)) / (case + frequency / related + found_in / sentences[doc] / related)
    return term, np.where(ok, weight, np.nan)


def _candidates(w: _Words, usable: np.ndarray, n_min: int, n_max: int, window: int):
    """For each length: (doc, codes, kf, product, total, sentence, begin, end) of the different runs of usable words in one sentence."""
    term, weights = _weights(w, usable, window)
    order = np.lexsort((w.i, w.sentence, w.doc))
    order = order[usable[w.code[order]]]
    term, weight = term[order], weights[term[order]]
    doc, sentence, i, start, end, code = (x[order] for x in (w.doc, w.sentence, w.i, w.start, w.end, w.code))
    run, product, total, group = np.arange(len(term)), weight, weight, term
    for n in range(1, n_max + 1):
        if n > 1:
            d = n - 1
            inside = run + d < len(term)
            at = run[inside]
            adjacent = (doc[at + d] == doc[at]) & (sentence[at + d] == sentence[at]) & (i[at + d] == i[at] + d)
            kept = np.flatnonzero(inside)[adjacent]
            run = run[kept]
            product, total = product[kept] * weight[run + d], total[kept] + weight[run + d]
            group = np.unique(group[kept] * (len(weights) + 1) + term[run + d], return_inverse=True)[1]
        if n >= n_min and len(run):
            last = end[run + n - 1]
            by = np.lexsort((last, start[run], sentence[run], group))
            heads = by[np.flatnonzero(np.diff(group[by], prepend=-1))]
            kf = np.diff(np.flatnonzero(np.diff(group[by], prepend=-1)), append=len(by))
            at = run[heads]
            yield doc[at], [code[at + d] for d in range(n)], kf, product[heads], total[heads], sentence[at], start[at], last[heads]


def _best(doc: np.ndarray, score: np.ndarray, top: int, threshold: float) -> np.ndarray:
    """Rows that can be among the ``top`` of their document once scores are rounded to nine decimals."""
    order = np.lexsort((score, doc))
    first = np.flatnonzero(np.diff(doc[order], prepend=-1))
    size = np.diff(first, append=len(order))
    worst = score[order][first + np.minimum(size, top) - 1]
    return np.sort(order[(score[order] <= np.repeat(worst, size) + 1e-8) & (score[order] <= threshold + 1e-8)])


def yake(
    df: DataFrame, key: str, col: str, n_min: int = 1, n_max: int = 3, top: int = 30, threshold: float = 1.5, window: int = 3
) -> DataFrame:
    """(key, keyword, score, begin, end, sentence, rank): the ``top`` candidates per document with score <= threshold.

    A candidate is a run of usable words in one sentence; lower scores are better. Scores have
    nine decimals, so that equal ones rank by keyword and not by the last bit of a logarithm.
    Documents are hash-partitioned by key once, into as many tasks as the session shuffles to, and
    cut into words in the row. Terms and candidates are counted over Arrow batches, so that words
    never become rows; what is left to rank is little more than ``top`` rows per document.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(F.col(key), F.col(col).alias("_text")).filter(F.col("_text").isNotNull()).repartition(tasks, F.col(key))
    texts = placed.groupBy(key).agg(F.collect_list("_text").alias("_texts")).select(key, F.transform("_texts", _word_arrays).alias("_texts"))
    stop_words = set(V.STOP_WORDS)
    schema = StructType([texts.schema[key]]).add("keyword", "string").add("kf", "long").add("product", "double").add("total", "double")
    for c in ("sentence", "begin", "end"):
        schema = schema.add(c, "integer")

    def counted(keys: pa.Array, texts: pa.ListArray):
        w = _Words(texts)
        usable = np.array([t not in stop_words and len(t) > 2 and not "0" <= t[0] <= "9" for t in w.terms.to_pylist()], bool)
        if not len(w.code) or not usable.any():
            return
        parts = list(_candidates(w, usable, n_min, n_max, window))
        if not parts:
            return
        words = [pc.binary_join_element_wise(*[w.terms.take(pa.array(c)) for c in p[1]], " ") for p in parts]
        doc, kf, product, total, sentence, begin, end = (np.concatenate([p[c] for p in parts]) for c in (0, 2, 3, 4, 5, 6, 7))
        kept = _best(doc, product / (kf * (1 + total)), top, threshold)
        yield pa.RecordBatch.from_arrays(
            [
                keys.take(pa.array(doc[kept])), pa.concat_arrays(words).take(pa.array(kept)), pa.array(kf[kept]), pa.array(product[kept]), pa.array(total[kept]),
                *[pa.array(x[kept], pa.int32()) for x in (sentence, begin, end)],
            ],
            schema.names,
        )

    def run(batches):
        for batch in batches:
            keys, texts = batch.columns
            # few words at a time, so that memory does not depend on the lengths of texts
            low = texts.flatten().flatten()[0]
            words = np.append(0, np.cumsum(pc.list_value_length(low).to_numpy(zero_copy_only=False)))
            ends = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))
            slices = words[ends] // SLICE_WORDS
            bounds = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            for a, b in zip(bounds, bounds[1:]):
                yield from counted(keys.slice(a, b - a), texts.slice(a, b - a))

    rows = texts.mapInArrow(run, schema)
    score = F.round(F.col("product") / (F.col("kf") * (1 + F.col("total"))), 9)
    scored = rows.select(key, "keyword", score.alias("score"), "begin", "end", "sentence").filter(F.col("score") <= threshold)
    return top_k(scored, [key], [F.asc("score"), F.asc("keyword")], top)


def keyword_rows(df: DataFrame, key: str, col: str, **options) -> DataFrame:
    """Keyword table in document and relevance order."""
    return yake(df, key, col, **options).orderBy(key, "score", "keyword")


def keyword_arrays(df: DataFrame, key: str, col: str, out: str = "keywords", **options) -> DataFrame:
    """(key, keywords[]) best first."""
    rows = yake(df, key, col, **options)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda r: r["keyword"]).alias(out))


def keywords_per_column(df: DataFrame, key: str, columns: dict[str, str], **options) -> DataFrame:
    """One keyword array per text column; all columns go through one pass as (key, column) rows."""
    entries = F.array(*[F.struct(F.lit(out).alias("_col"), F.col(src).alias("_text")) for src, out in columns.items()])
    stacked = df.select(key, F.inline(entries)).filter(F.col("_text").isNotNull()).withColumn("_id", F.struct(key, "_col"))
    arrays = keyword_arrays(stacked, "_id", "_text", "_kw", **options).select("_id.*", "_kw")
    wide = arrays.groupBy(key).agg(*[F.first(F.when(F.col("_col") == out, F.col("_kw")), ignorenulls=True).alias(out) for out in columns.values()])
    empty = F.array().cast("array<string>")
    return df.join(wide, key, "left").withColumns({out: F.coalesce(out, empty) for out in columns.values()})


def order_by_relevance(keywords: DataFrame, key: str) -> DataFrame:
    """Keywords with their rank inside the document, lowest score first, ties in term order."""
    ranked = keywords.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("score", "term")).cast("bigint"))
    return ranked.orderBy(key, "score", "term")
