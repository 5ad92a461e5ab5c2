"""Probability vectors, label names and small score rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..resources import values as V
from .expr import let, string_array, string_map


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, so large logits do not overflow."""

    def scaled(arr: Column) -> Column:
        powers = F.transform(arr, lambda x: F.exp(x - F.array_max(arr)))
        return let(
            powers,
            lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda acc, y: acc + y)),
        )

    return let(logits, scaled)


def argmax_index(values: Column) -> Column:
    """0-based position of the largest value, the first one on ties; NULL when empty."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_label(values: Column, labels: Sequence[str]) -> Column:
    return F.get(string_array(labels), argmax_index(values))


def rank_labels(values: Column, labels: Sequence[str]) -> Column:
    """(label, probability), most probable first, ties in label order."""
    zipped = F.transform(
        values, lambda p, i: F.struct((-p).alias("neg"), i.alias("i"), F.get(string_array(labels), i).alias("label"))
    )
    return F.transform(
        F.array_sort(zipped), lambda z: F.struct(z["label"].alias("label"), (-z["neg"]).alias("probability"))
    )


def normalise_label(col: Column, aliases: dict[str, str] = V.LABEL_ALIASES) -> Column:
    return F.coalesce(F.element_at(string_map(aliases), col), F.upper(col))


def align(scores: Column, labels: Sequence[str]) -> Column:
    """Probabilities in declared label order, 0 where the map has no entry."""
    return F.array(*[F.coalesce(F.element_at(scores, F.lit(x)), F.lit(0.0)) for x in labels])


def class_columns(values: Column, labels: Sequence[str]) -> list[Column]:
    """One probability column per class."""
    return [F.get(values, i).alias(label.lower()) for i, label in enumerate(labels)]


def star_bucket(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low.isin("1 star", "2 stars"), "negative").when(low.isin("4 stars", "5 stars"), "positive").otherwise("neutral")
    )


def polarity_label(compound: Column, cut: float = V.POLARITY_CUT) -> Column:
    return F.when(compound >= cut, "positive").when(compound <= -cut, "negative").otherwise("neutral")


def any_positive(positive_share: Column) -> Column:
    return F.when(positive_share > 0, 1).otherwise(0)


def label_confidence(scores: Column, label: Column) -> Column:
    """Score of the predicted label, from a map of all scores; null where the map does not have it."""
    return F.try_element_at(scores, label)
