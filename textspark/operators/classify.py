"""Text classifiers: naive Bayes, averaged word vectors, and scoring with any per-text model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import argmax_index, softmax
from .corpus import bag_of_words, term_rows
from .scale import checkpointed, counted_lookup

TASK_WORDS = 2_000_000  # words that one task learns vectors from in an epoch
Scorer = Callable[[pd.Series], pd.DataFrame]


@dataclass
class NaiveBayes:
    """Multinomial model: log priors by label, and (term, w) with a log probability for each label."""

    labels: list
    priors: list[float]
    weights: DataFrame


def train_naive_bayes(df: DataFrame, tokens: str, label: str, smoothing: float = 1.0) -> NaiveBayes:
    """Exact counts per (label, term), no hashing; labels are few and come to the driver."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()}
    counts = checkpointed(term_rows(df, tokens, [label]).groupBy(label, "term").agg(F.count("*").alias("n")))
    totals = {r[label]: r["n"] for r in counts.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    terms = counts.select("term").distinct().count()
    per_term = counts.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, c in enumerate(sizes)])
    weight = [F.log((F.col(f"n{i}") + smoothing) / (totals.get(c, 0) + smoothing * terms)) for i, c in enumerate(sizes)]
    total = sum(sizes.values())
    priors = [math.log((n + smoothing) / (total + smoothing * len(sizes))) for n in sizes.values()]
    return NaiveBayes(list(sizes), priors, checkpointed(per_term.select("term", F.array(*weight).alias("w"), sum((F.col(f"n{i}") for i in range(len(sizes))), F.lit(0)).alias("n"))))


def predict_naive_bayes(model: NaiveBayes, df: DataFrame, key: str, tokens: str, names: Sequence[str] | None = None) -> DataFrame:
    """(key, prediction, probabilities, label) of every row; terms never seen in training do not count."""
    k = len(model.labels)
    bag = bag_of_words(df, key, tokens).withColumnRenamed("n", "_n")
    known = counted_lookup(bag, model.weights, ["term"], "n", F.col(key)).filter(F.col("w").isNotNull())
    sums = known.groupBy(key).agg(F.array(*[F.sum(F.col("_n") * F.get("w", i)) for i in range(k)]).alias("s"))
    scores = [F.lit(model.priors[i]) + F.coalesce(F.get("s", i), F.lit(0.0)) for i in range(k)]
    scored = df.select(key).join(sums, key, "left").select(key, F.array(*scores).alias("s"))
    out = scored.select(key, argmax_index(F.col("s")).cast("int").alias("prediction"), softmax(F.col("s")).alias("probabilities"))
    named = [F.lit(x) for x in (names or model.labels)]
    return out.withColumn("label", F.get(F.array(*named), F.col("prediction")))


def train_text_classifier(
    train: DataFrame, validation: DataFrame, tokens: str, label: str, size: int = 50, epochs: int = 2, min_count: int = 5, reg: Sequence[float] = (0.0, 0.01), seed: int = 42
) -> tuple[PipelineModel, dict[str, float]]:
    """Mean of learned word vectors, then a linear layer; the model best on the validation rows is kept.

    Word vectors are learned in one task for each ``TASK_WORDS`` words and averaged after each epoch. Rows are tokenised once.
    """
    rows = train.select(tokens, label).persist()
    found = rows.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    tasks = max(1, math.ceil(found / TASK_WORDS))
    words = Word2Vec(vectorSize=size, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=tasks, inputCol=tokens, outputCol="_f").fit(rows)
    prepared, held = (words.transform(x).select("_f", label).persist() for x in (rows, validation))
    best, best_scores = None, {"validation_accuracy": -1.0}
    for strength in reg:
        linear = LogisticRegression(featuresCol="_f", labelCol=label, regParam=strength, maxIter=50).fit(prepared)
        scores = {"train_accuracy": accuracy(linear, prepared, label), "validation_accuracy": accuracy(linear, held, label)}
        if scores["validation_accuracy"] > best_scores["validation_accuracy"]:
            best, best_scores = PipelineModel(stages=[words, linear]), scores
    for x in (prepared, held, rows):
        x.unpersist()
    return best, best_scores


def accuracy(model: Transformer, df: DataFrame, label: str) -> float:
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(model.transform(df))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """Kept columns, class index, probabilities and, with ``labels``, the label name."""
    out = model.transform(df).select(*keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probabilities"))
    if labels is None:
        return out
    return out.withColumn("label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction")))


def score_with_model(
    df: DataFrame, key: str, text: str, make_scorer: Callable[[], Scorer], labels: Sequence[str], on_error: str | None = "error"
) -> DataFrame:
    """(key, label, probabilities) from any per-text model.

    ``make_scorer`` runs once per task, so a heavy model is loaded once and not per
    row. The scorer takes a series of texts and returns one column per label. A batch that
    fails is halved until the failing rows are alone; only those get ``on_error``.
    """
    kind = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("label", T.StringType()), T.StructField("probabilities", T.ArrayType(T.DoubleType()))]
    )
    names = list(labels)

    def frame(ids: pd.Series, scored: pd.DataFrame) -> pd.DataFrame:
        aligned = scored.reindex(columns=names, fill_value=0.0).astype(float)
        return pd.DataFrame({key: ids.to_numpy(), "label": aligned.idxmax(axis=1).to_numpy(), "probabilities": list(aligned.to_numpy())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            if batch.empty:
                continue
            yield pd.concat(parts(batch, scorer))

    def parts(batch: pd.DataFrame, scorer: Scorer) -> list[pd.DataFrame]:
        try:
            return [frame(batch[key], scorer(batch[text]))]
        except Exception:
            if on_error is None:
                raise
        if len(batch) == 1:
            return [pd.DataFrame({key: batch[key].to_numpy(), "label": [on_error], "probabilities": [[0.0] * len(names)]})]
        half = len(batch) // 2
        return parts(batch.iloc[:half], scorer) + parts(batch.iloc[half:], scorer)

    return df.select(key, text).mapInPandas(run, schema)
