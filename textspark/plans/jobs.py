"""Whole jobs: operators chained into one plan per result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions import spans as S
from ..functions import text as T
from ..operators import corpus, pii, sentiment
from ..operators.deid import deidentify
from ..operators.filters import record_problem, route


def analyse_records(
    df: DataFrame, key: str, patient: str, text: str, lexicon: DataFrame, entities: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(results, errors): redaction, entities and sentiment of every record; a bad record never stops the batch.

    Redaction stays in the row; only one short score row per record is joined by key.
    """
    ok, errors = route(df, record_problem(patient, text))
    found = pii.detect(ok, text, entities)
    redacted = found.select(
        key,
        patient,
        T.preview(F.col(text)).alias("text_preview"),
        S.replace_spans(F.col(text), F.col("spans"), M.label_text).alias("redacted_text"),
        F.col("spans").alias("pii_entities"),
        F.size("spans").alias("pii_entity_count"),
    )
    scored = sentiment.labelled_polarity(ok, key, text, lexicon)
    return redacted.join(scored, key, "left"), errors.select(key, patient, "error")


def entity_report(df: DataFrame, key: str, text: str, entities: Sequence[str] | None = None, check_cards: bool = True) -> DataFrame:
    """Detect, then count per label: (label, n_entities, n_docs)."""
    found = pii.detect(df, text, entities, check_cards=check_cards)
    return pii.label_stats(pii.explode_spans(found, "spans", [key]), key)


def redact_columns(df: DataFrame, cols: Sequence[str], entities: Sequence[str] | None = None, prefix: str = "redacted_") -> DataFrame:
    """Every listed text column redacted into a column placed right behind it; all in one pass."""
    from ..operators.filters import insert_after

    out = df
    for c in cols:
        out = deidentify(pii.detect(out, c, entities, out="_spans"), c, "_spans", "label", f"{prefix}{c}").drop("_spans")
    return insert_after(out, {c: f"{prefix}{c}" for c in cols})


def topic_terms(df: DataFrame, key: str, text: str, lemmas: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(key, unigrams, tags, final): tokens, lemmas, tags, then tag-filtered unigrams and n-grams.

    Tags are given before anything is filtered, so tokens and tags stay aligned.
    """
    base = df.select(key, T.normalise_tokens(T.tokens(F.col(text))).alias("tokens"))
    if lemmas is not None:
        base = corpus.lemmatise(base, key, "tokens", lemmas, out="tokens")
    tagged = corpus.with_pos_tags(base, "tokens", lexicon)
    unigrams = T.remove_stops(T.filter_pos(F.col("tokens"), F.col("tags")))
    grams = T.filter_pos_ngrams(T.ngrams(F.col("tokens"), 3), T.ngrams(F.col("tags"), 3))
    return tagged.select(key, "tokens", "tags", unigrams.alias("unigrams"), grams.alias("ngrams")).select(
        key, "unigrams", "tags", T.final_terms(F.col("unigrams"), F.col("ngrams")).alias("final")
    )
