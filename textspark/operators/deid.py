"""Redacting, masking, obfuscating and restoring text, and masking table columns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import masks as M
from ..functions import spans as S
from ..functions.expr import let, seeded_index, string_array
from ..functions.text import detect_language
from ..resources import values as V
from . import pii
from .dictionary import with_dictionary_spans
from .language import detect_by_profile
from .scale import checkpointed, counted_lookup, grouped_position
from .words import SHARD_WORDS, looked_up

REGISTRY_SHARDS = 8

# ---------------------------------------------------------------- one replacement per span


def deidentify(
    df: DataFrame,
    text: str,
    spans: str,
    strategy: str = "placeholder",
    out: str = "deidentified",
    mapping: dict[str, str] | None = None,
    single: str | None = None,
) -> DataFrame:
    """Strategies: placeholder, redact, hash, label, entity_labels, same_length_chars, custom (with ``mapping``)."""
    if single is not None:
        how = M.single_text(single)
    elif strategy == "custom":
        how = M.custom(mapping or {})
    elif strategy in M.STRATEGIES:
        how = M.STRATEGIES[strategy]
    else:
        raise ValueError(f"unknown strategy {strategy!r}: use {sorted([*M.STRATEGIES, 'custom'])}")
    return df.withColumn(out, S.replace_spans(F.col(text), F.col(spans), how))


def redact_labels(df: DataFrame, text: str, spans: str, out: str = "redacted", skip: Sequence[str] = ("ORG",)) -> DataFrame:
    """[LABEL] for every span but skipped labels and blank spans."""
    wanted = F.filter(F.col(spans), lambda s: ~s["label"].isin(*skip) & (F.trim(s["text"]) != ""))
    return df.withColumn(out, S.replace_spans(F.col(text), wanted, M.label_text))


def mask(df: DataFrame, text: str, spans: str, policy: str = "entity_labels", n: int = 4, out: str = "masked") -> DataFrame:
    how = {
        "entity_labels": M.angle_label,
        "same_length_chars": M.same_length,
        "fixed_length_chars": M.fixed_length(n),
    }[policy]
    return df.withColumn(out, S.replace_spans(F.col(text), F.col(spans), how))


def obfuscate(
    df: DataFrame, text: str, spans: str, source: str = "faker", reference: dict | None = None, seed: int = 42, out: str = "obfuscated"
) -> DataFrame:
    how = M.from_pool(M.merge_pools(source, reference), seed)
    return df.withColumn(out, S.replace_spans(F.col(text), F.col(spans), how))


def multi_mode(
    df: DataFrame, text: str, spans: str, modes: dict[str, Sequence[str]], default: str = "mask_entity_labels", n: int = 4, out: str = "deidentified"
) -> DataFrame:
    actions = {**M.MODE_ACTIONS, "mask_fixed_length_chars": M.fixed_length(n)}
    return df.withColumn(out, S.replace_spans(F.col(text), F.col(spans), M.by_label(modes, actions[default], actions)))


def all_outputs(df: DataFrame, text: str, spans: str, n: int = 4, seed: int = 42) -> DataFrame:
    """Four de-identified texts from one span column, found once."""
    policies = {
        "masked_labels": M.angle_label,
        "masked_same_length": M.same_length,
        "masked_fixed_length": M.fixed_length(n),
        "obfuscated": M.from_pool(V.POOLS, seed),
    }
    return df.select("*", *[S.replace_spans(F.col(text), F.col(spans), how).alias(name) for name, how in policies.items()])


def obfuscate_age(df: DataFrame, text: str, spans: str, policy: str = "groups", out: str = "obfuscated", seed: int = 42, limit: int = 89) -> DataFrame:
    """AGE spans by group name, by another age of the same range, or only above the limit."""
    rule = {
        "groups": lambda t: M.age_group(t),
        "ranges": lambda t: M.age_in_range(t, seed=seed),
        "hipaa": lambda t: M.age_hipaa(t, limit),
    }[policy]
    ages = S.keep_labels(F.col(spans), allow=["AGE"])
    return df.withColumn(out, S.replace_spans(F.col(text), ages, lambda s: rule(s["text"])))


def shift_dates(
    df: DataFrame,
    text: str,
    spans: str,
    days: Column,
    on_fail: str = "mask",
    seed: int = 42,
    out: str = "shifted",
    date_label: str = "DATE",
) -> DataFrame:
    """DATE spans moved by ``days``; dates that cannot be read are masked or replaced from the pool."""
    pool = M.from_pool(V.POOLS, seed)

    def how(s):
        fallback = M.angle_label(s) if on_fail == "mask" else pool(s)
        return F.coalesce(M.shift_date(s["text"], days), fallback)

    dates = S.keep_labels(F.col(spans), allow=[date_label])
    return df.withColumn(out, S.replace_spans(F.col(text), dates, how))


def synthesise(df: DataFrame, key: str, text: str, spans: str, seed: int = 42, out: str = "synthetic") -> DataFrame:
    """Per row, every entity type found gets one synthetic value."""
    pools = {
        "PERSON": V.POOLS["NAME"], "EMAIL_ADDRESS": V.POOLS["EMAIL"], "PHONE_NUMBER": V.POOLS["PHONE"],
        "LOCATION": V.POOLS["LOCATION"], "DATE_TIME": V.POOLS["DATE"], "CREDIT_CARD": V.POOLS["CREDIT_CARD"],
    }

    def how(s):
        value = M.from_pool(pools, seed, key=lambda x: F.concat(F.col(key).cast("string"), F.lit(":"), x["label"]))(s)
        return F.when(s["label"].isin(*pools), value).otherwise(V.SYNTHETIC_DEFAULT)

    return df.withColumn(out, S.replace_spans(F.col(text), F.col(spans), how))


# ---------------------------------------------------------------- consistent pseudonyms


def pseudonym_registry(df: DataFrame, spans: str, order: str) -> DataFrame:
    """(label, text, n, number): running number per label in order of first sight.

    First sight follows ``order``, and inside a document runs from right to left.
    """
    return _number_pairs(pii.explode_spans(df.withColumn("_order", F.col(order)), spans, ["_order"]))


def _number_pairs(found: DataFrame) -> DataFrame:
    """Occurrences are reduced to one row per (label, text) before anything is sorted, and the
    numbering is a range-partitioned sort, so no label has to fit one task."""
    seen = found.groupBy("label", "text").agg(
        F.min(F.struct(F.col("_order"), (-F.col("start")).alias("_right"))).alias("_first"), F.count("*").alias("n")
    )
    return grouped_position(seen, ["label"], [F.col("_first")], "number").drop("_first")


def consistent(
    df: DataFrame, key: str, text: str, spans: str, order: str | None = None, scope: str = "batch", registry: DataFrame | None = None, out: str = "deidentified"
) -> DataFrame:
    """Equal (label, text) -> equal pseudonym over the batch, or per document with ``scope="document"``.

    The rows are written once with their spans, so the detectors run a single time. Pseudonyms are then looked up in the
    row, a registry of up to ``REGISTRY_SHARDS`` shards in as many narrow passes, and no text is shuffled;
    a larger registry is joined with the span rows, and those with the texts that have spans.
    """
    if scope == "document":
        new = df.withColumn("_new", _numbered_in_document(F.col(spans)))
        return new.withColumn(out, S.replace_spans(F.col(text), F.coalesce("_new", S.no_spans()), lambda s: s["text"])).drop("_new")
    whole = checkpointed(df)
    found = pii.explode_spans(whole.withColumn("_order", F.col(order or key)), spans, [key, "_order"])
    if registry is None:
        registry = checkpointed(_number_pairs(found))
    if registry.count() <= REGISTRY_SHARDS * SHARD_WORDS:
        pair = lambda label, value: F.concat(label, F.lit("\x1f"), value)
        ordered = whole.withColumn("_spans", F.array_sort(F.coalesce(F.col(spans), S.no_spans())))
        keyed = ordered.withColumn("_pairs", F.transform("_spans", lambda s: pair(s["label"], s["text"])))
        table = registry.select(pair(F.col("label"), F.col("text")).alias("pair"), F.col("number").cast("bigint").alias("number"))
        named = looked_up(keyed, "_pairs", table, "pair", "number", "_numbers")
        new = F.zip_with("_spans", "_numbers", lambda s, n: S.span(s["start"], s["end"], M.pseudonym(s["label"], n), s["label"], F.lit(1.0)))
        return named.withColumn(out, S.replace_spans(F.col(text), new, lambda s: s["text"])).drop("_spans", "_pairs", "_numbers")
    named = counted_lookup(checkpointed(found), registry, ["label", "text"], "n", F.struct(key, "start"))
    new = S.span(F.col("start"), F.col("end"), M.pseudonym(F.col("label"), F.col("number")), F.col("label"), F.lit(1.0))
    replacements = named.groupBy(key).agg(F.array_sort(F.collect_list(new)).alias("_new"))
    some = F.coalesce(F.size(spans) > 0, F.lit(False))
    joined = whole.where(some).join(replacements, key, "left")
    changed = joined.withColumn(out, S.replace_spans(F.col(text), F.coalesce("_new", S.no_spans()), lambda s: s["text"])).drop("_new")
    return changed.unionByName(whole.where(~some).withColumn(out, F.col(text)))


@F.pandas_udf(ArrayType(LongType()))
def _numbers_in_document(labels: pd.Series, texts: pd.Series) -> pd.Series:
    """For spans in text order the number of their text among those of their label, seen from the right; one pass."""

    def number(own, words):
        seen: dict = {}
        per_label: dict = {}
        out = [0] * len(own)
        for i in range(len(own) - 1, -1, -1):
            pair = own[i], words[i]
            if pair not in seen:
                seen[pair] = per_label[own[i]] = per_label.get(own[i], 0) + 1
            out[i] = seen[pair]
        return out

    return pd.Series([None if a is None else number(a, b) for a, b in zip(labels, texts, strict=True)])


def _numbered_in_document(spans: Column) -> Column:
    """The spans in text order with their pseudonyms as text."""
    ordered = F.array_sort(spans)
    numbers = _numbers_in_document(F.transform(ordered, lambda s: s["label"]), F.transform(ordered, lambda s: s["text"]))
    return F.zip_with(ordered, numbers, lambda s, n: S.span(s["start"], s["end"], M.pseudonym(s["label"], n), s["label"], F.lit(1.0)))


# ---------------------------------------------------------------- mapping and back


def with_mapping(df: DataFrame, text: str, spans: str, strategy: str = "placeholder", out: str = "deidentified", mapping: str = "mapping") -> DataFrame:
    how = M.STRATEGIES[strategy]
    return df.withColumn(out, S.replace_spans(F.col(text), F.col(spans), how)).withColumn(
        mapping, S.mapping_of(F.col(spans), how)
    )


def reidentify(df: DataFrame, text: str = "deidentified", mapping: str = "mapping", out: str = "restored") -> DataFrame:
    return df.withColumn(out, S.restore(F.col(text), F.col(mapping)))


# ---------------------------------------------------------------- keywords


def keep_overlapping(keywords: Column, entities: Column) -> Column:
    """Distinct keywords that equal, lie in, or contain one of the entity texts, in any case."""

    def near(low: Column) -> Column:
        return F.filter(
            keywords,
            lambda k: let(F.lower(k), lambda w: F.exists(low, lambda e: F.contains(e, w) | F.contains(w, e))),
        )

    # bound once per row: inside the lambda the entities would be found anew for every keyword
    return F.array_distinct(let(F.transform(entities, lambda e: F.lower(e)), near))


def keyword_spans(text: Column, keywords: Column, label: str) -> Column:
    """Positions of literal phrases, whole word and any case.

    The phrases of a row form one alternation, longest first, so the text is read once.
    """

    def located(pattern: Column) -> Column:
        found = F.regexp_extract_all(text, pattern, F.lit(0))

        def walk(ms):
            def with_gaps(gaps):
                from ..functions.expr import running_offsets

                steps = F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

                def place(before):
                    def one(m, i):
                        at = F.get(before, i) + F.length(F.get(gaps, i))
                        return S.span(at, at + F.length(m), m, F.lit(label), F.lit(1.0))

                    return F.transform(ms, one)

                return let(running_offsets(steps), place)

            return let(F.split(text, pattern, -1), with_gaps)

        return let(found, walk)

    escaped = F.transform(
        M.longest_first(F.filter(keywords, lambda k: F.length(k) > 0)),
        lambda k: F.regexp_replace(k, r"([\\.\[\]{}()*+?^$|\-#&~\s])", r"\\$1"),
    )
    pattern = F.concat(F.lit(rf"(?iu){V.LEFT}(?:"), F.array_join(escaped, "|"), F.lit(rf"){V.RIGHT}"))
    return F.when(F.size(escaped) > 0, let(pattern, located)).otherwise(S.no_spans())


def highlight_layers(text: Column, regex: Column, keywords: Column, entities: Column) -> Column:
    """Regex spans, then keywords that overlap an entity, then the remaining entities; left to right, no overlaps."""
    entity_texts = F.transform(entities, lambda e: e["text"])
    both = keyword_spans(text, keep_overlapping(keywords, entity_texts), "keyword")
    alone = F.transform(entities, lambda s: s.withField("label", F.lit("entity")))
    shown = F.transform(regex, lambda s: s.withField("label", F.lit("regex")))
    return S.non_overlapping(S.prefer_first(shown, both, alone, clash=S.inside))


def highlight(text: Column, spans: Column, marks: dict[str, tuple[str, str]] | None = None) -> Column:
    """Every span wrapped in the marks of its label, [[…]] by default."""

    def how(s):
        out = F.concat(F.lit("[["), s["text"], F.lit("]]"))
        for label, (a, b) in (marks or {}).items():
            out = F.when(s["label"] == label, F.concat(F.lit(a), s["text"], F.lit(b))).otherwise(out)
        return out

    return S.replace_spans(text, spans, how)


# ---------------------------------------------------------------- whole jobs on one column


ROUTED_ENTITIES = ["EMAIL_ADDRESS", "IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS", "DATE_TIME", "PHONE_NUMBER"]


def redact_by_language(
    df: DataFrame, text: str, phrases: DataFrame | dict[str, dict[str, Sequence[str]]], out: str = "redacted", languages: Sequence[str] = ("en", "fr"), default: str = "fr",
    shortest: int = 20, key: str | None = None, profiles: DataFrame | None = None,
) -> DataFrame:
    """Texts redacted by the patterns and by the dictionary of their language; adds ``language`` too.

    ``phrases`` is a table (language, phrase, label) of any size, of which only the phrases of a text's own
    language and those without one are looked for; or short lists as {language: {label: phrases}}. Texts below ``shortest`` characters
    and those of other languages count as ``default``. Languages are told by frequent words, or by the ``profiles`` of
    ``language_profiles``. On overlap a pattern wins. Null and blank texts stay as they are.
    """
    t = F.col(text)
    df = df.withColumn("language", detect_language(t)) if profiles is None else detect_by_profile(df, text, profiles, "language")
    language = F.when((F.length(F.trim(t)) >= shortest) & F.col("language").isin(*languages), F.col("language")).otherwise(default)
    if isinstance(phrases, dict):
        rows = [(of, p.lower(), label) for of, labels in phrases.items() for label, listed in labels.items() for p in listed]
        phrases = df.sparkSession.createDataFrame(rows, "language string, phrase string, label string")
    staged = with_dictionary_spans(df.withColumn("language", language), text, phrases, "language", "_listed", key)
    spans = S.non_overlapping(S.prefer_first(pii.detector_spans(t, ROUTED_ENTITIES), S.non_overlapping(F.col("_listed"))))
    redacted = F.when(F.length(F.trim(t)) > 0, S.replace_spans(t, F.col("_spans"), M.label_text)).otherwise(t)
    return staged.withColumn("_spans", spans).withColumn(out, redacted).drop("_listed", "_spans")


def redact_first(df: DataFrame, text: str, next_step, entities: Sequence[str] | None = None) -> DataFrame:
    """Redact, then hand only the redacted text on.

    The original text is dropped, so no later step can see it; a text that could
    not be redacted arrives as NULL and never as the original.
    """
    found = pii.detect(df, text, entities, out="_spans")
    safe = found.withColumn("_redacted", S.replace_spans(F.col(text), F.col("_spans"), M.label_text)).withColumn(
        "entity_count", F.size("_spans")
    )
    return next_step(safe.drop(text, "_spans").withColumnRenamed("_redacted", text))


def deidentify_columns(
    df: DataFrame, columns: dict[str, str], seeds: dict[str, int] | None = None, days: int = 0, reference: dict | None = None, source: str = "faker",
    day_first: bool = True,
) -> DataFrame:
    """Named columns replaced by fake values of their type; DATE columns are shifted by ``days``."""
    pools = M.merge_pools(source, reference)
    changed = {}
    for column, kind in columns.items():
        seed = (seeds or {}).get(column, 42)
        value = F.col(column).cast("string")
        if kind == "DATE":
            formats = M.DAY_FIRST_FORMATS + M.DATE_FORMATS[1:] if day_first else M.DATE_FORMATS
            changed[column] = F.coalesce(M.shift_date(value, F.lit(days), formats), F.when(value.isNotNull(), F.lit("<DATE>")))
        elif kind in pools:
            options = pools[kind]
            changed[column] = F.when(
                value.isNotNull(), F.element_at(string_array(options), seeded_index(value, seed, len(options)) + 1)
            )
        else:
            raise ValueError(f"no pool for type {kind!r}")
    return df.withColumns(changed)


def mask_column(df: DataFrame, col: str, char: str = "#", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, M.mask_all(F.col(col), char))


def mask_column_part(df: DataFrame, col: str, char: str, first: bool, n: int, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, M.mask_part(F.col(col), char, first, n))


def hash_column(df: DataFrame, col: str, salt: str | None = None, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, M.hash_text(F.col(col), salt))


def read_reference(spark: SparkSession, path: str, limit: int | None = None) -> dict[str, list[str]]:
    """``value#TYPE`` lines as pools. The list goes into the plan; ``limit`` makes a longer one an error."""
    lines = spark.read.text(path).filter(F.col("value").contains("#"))
    rows = lines.select(
        F.substring_index("value", "#", 1).alias("v"), F.substring_index("value", "#", -1).alias("k")
    )
    rows = (rows if limit is None else rows.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"reference list has more than {limit} values")
    pools: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.k, r.v)):
        pools.setdefault(row.k, []).append(row.v)
    return pools
