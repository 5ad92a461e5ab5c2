"""Quality classifier: a regularised quadratic discriminant over statistics of the text.

Spark sums, for each class, the transformed statistics of labelled rows and their products; from
those few numbers come the class means and covariances, shrunk to their diagonal and to a share of the
pooled one. A text's score is the logistic of the difference of two Gaussian log densities,
whose Cholesky factors are inverted once and go to the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import fold, query, table, texts, with_columns, words, written
from textspark.llm.quality_rules import SPACE, SYMBOL, repeated_words

STATISTICS = [
    "log_words", "word_length", "word_spread", "symbols", "capitals", "digits", "stops", "bars", "distinct", "doubled", "again", "same_lines", "line_words", "entropy",
]
SHRINK = 0.05  # weight of the diagonal in a class covariance
POOL = 0.1  # weight of the pooled covariance
FLOOR = 1e-3  # added to each variance
THRESHOLD = 0.3
DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def statistics(text: bytes) -> list[float]:
    """``STATISTICS`` of a whole text, transformed to lie near a bell curve; all defined for an empty one."""
    tokens, data = words(text), np.frombuffer(text, np.uint8)
    n, size = len(tokens), max(1, len(data))
    lengths = np.fromiter(map(len, tokens), np.float64, n)
    freq = np.bincount(data, minlength=256) / size
    share = lambda mask: math.sqrt(float(freq[mask].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    used = freq[(freq > 0) & ~SPACE]
    return [
        math.log1p(n), float(np.log1p(lengths).mean()) if n else 0.0, float(np.log1p(lengths).std()) if n else 0.0,
        share(SYMBOL), share(CAPITAL), share(DIGIT), share(STOP), math.sqrt(float(freq[124])),
        math.log(len(set(tokens)) / n) if n else 0.0, math.sqrt(sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / max(1, n)),
        math.sqrt(repeated_words(tokens) / max(1, n)), math.sqrt((len(lines) - len(set(lines))) / max(1, len(lines))),
        math.log1p(n / max(1, len(lines))), float(-(used * np.log(used)).sum()),
    ]


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, x): the statistics of each row's text; null is empty."""
    made = lambda c: {"x": pa.array([statistics(t) for t in texts(c)], pa.list_(pa.float64()))}
    return with_columns(docs, F.col(f"`{text}`"), made, {"x": "array<double>"})


class Discriminant:
    """Two Gaussians of ``moments``: class -> (rows, sums, sums of products)."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in moments.values())
        size = len(STATISTICS)
        spread = {c: p / n - np.outer(s / n, s / n) for c, (n, s, p) in moments.items()}
        pooled = sum((n / total) * spread[c] for c, (n, _, _) in moments.items()) if moments else np.zeros((size, size))
        self.parts = {}
        for c, (n, s, _) in moments.items():
            own = (1 - POOL) * spread[c] + POOL * pooled
            own = (1 - SHRINK) * own + SHRINK * np.diag(np.diag(own)) + FLOOR * np.eye(size)
            low = np.linalg.cholesky(own)
            self.parts[c] = s / n, np.linalg.inv(low), math.log(n / total) - float(np.log(np.diag(low)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; the share of it where only one class was seen, a half without any."""
        if len(self.parts) < 2:
            return np.full(len(x), float(next(iter(self.parts), 0.5)))
        density = {}
        for c, (mean, inverse, constant) in self.parts.items():
            z = (x - mean) @ inverse.T
            density[c] = constant - 0.5 * (z * z).sum(1)
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fitted(rows: DataFrame) -> Discriminant:
    """From rows (x, label): sums in Spark, one row for each class comes back."""
    k = len(STATISTICS)
    x = [F.col("x")[i] for i in range(k)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(k)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = {}
    for r in rows.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        moments[int(r["label"])] = float(r["n"]), np.array([r[f"s{i}"] for i in range(k)]), p
    return Discriminant(moments)


def classified(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Labels are learnt from rows whose fold of the id is not ``held``, one label (the largest) for
    an id. Null texts are empty; rows with a null id are scored and not learnt from; equal rows
    have equal scores.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = written(with_statistics(plain, "text").drop("text"), "statistics")
    known = labels.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max(label).alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(rows.join(known, "doc_id")))

    def run(column):
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))
        return {"score": pa.array(shared.value.scores(x))}

    scored = with_columns(rows, F.col("x"), run, {"score": "double"})
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op8_quality_discriminant")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 5, 0)
