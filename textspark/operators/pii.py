"""Finding personal data: span columns and span tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.expr import let, string_map
from ..resources import values as V
from .dictionary import dictionary_spans, with_dictionary_spans

# ---------------------------------------------------------------- detectors


def structured_spans(col: Column, patterns: Sequence[tuple[str, str]] = V.STRUCTURED_PATTERNS) -> Column:
    """Ordered patterns; a match of a later pattern that lies inside an earlier span is dropped."""
    return S.in_text_order(S.first_wins(S.match_many(col, patterns), clash=S.inside))


def passes_luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.call_function("luhn_check", digits)


def detector_spans(col: Column, entities: Sequence[str] | None = None, check_cards: bool = True, listed: Column | None = None) -> Column:
    """Generic detectors; where two overlap the one listed first wins.

    Card numbers must pass the checksum unless ``check_cards`` is off. Entities without a
    pattern are the labels of ``listed``, the spans of a dictionary; of two of its
    phrases with one label the one that starts first, then the longer one, wins.
    """
    names = list(V.DETECTOR_PATTERNS) if entities is None else list(entities)
    unknown = [n for n in names if n not in V.DETECTOR_PATTERNS]
    if unknown and listed is None:
        raise ValueError(f"no pattern for {unknown}: they need a dictionary; patterns: {sorted(V.DETECTOR_PATTERNS)}")
    parts = []
    for by_pattern, run in groupby(names, lambda n: n in V.DETECTOR_PATTERNS):
        run = list(run)
        parts.append(S.match_many(col, [(n, V.DETECTOR_PATTERNS[n]) for n in run]) if by_pattern else F.array(*[S.keep_labels(listed, allow=[n]) for n in run]))
    if entities is None and listed is not None:
        parts.append(F.array(listed))
    found = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array(S.no_spans())
    if check_cards and "CREDIT_CARD" in names:
        valid = lambda s: (s["label"] != "CREDIT_CARD") | passes_luhn(s["text"])
        found = F.transform(found, lambda spans: F.filter(spans, valid))
    return S.non_overlapping(S.first_wins(found))


def detect(
    df: DataFrame, col: str, entities: Sequence[str] | None = None, out: str = "spans", check_cards: bool = True,
    dictionary: DataFrame | None = None, language: str | None = None, key: str | None = None,
) -> DataFrame:
    """``df`` with the spans of all entities: patterns, and with a ``dictionary`` (phrase, label[, language]) its labels too,
    such as PERSON, LOCATION and NRP.

    Without ``entities`` all patterns and all labels are looked for. ``language`` names the column with the
    language of a text; ``key`` is only needed for a dictionary of more than one shard.
    """
    if dictionary is None:
        return df.withColumn(out, detector_spans(F.col(col), entities, check_cards))
    listed = with_dictionary_spans(df, col, dictionary, language, "_listed", key)
    return listed.withColumn(out, detector_spans(F.col(col), entities, check_cards, F.col("_listed"))).drop("_listed")


def structured(df: DataFrame, col: str, out: str = "spans", patterns=V.STRUCTURED_PATTERNS) -> DataFrame:
    """Structured-pattern spans, cleared of overlaps so they can be replaced."""
    return df.withColumn(out, S.non_overlapping(structured_spans(F.col(col), patterns)))


# ---------------------------------------------------------------- span tables


def explode_spans(df: DataFrame, spans: str, keep: Sequence[str]) -> DataFrame:
    """One row per span: the kept columns plus start, end, text, label, confidence.

    The outer form keeps Spark from adding a size filter below, which would
    evaluate a computed span column a second time.
    """
    return df.select(*keep, F.inline_outer(F.col(spans))).filter(F.col("start").isNotNull())


def union_spans(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def attach_spans(df: DataFrame, spans: DataFrame, key: str, out: str = "spans") -> DataFrame:
    """Span rows back to an array column; only documents with spans have anything to shuffle for."""
    grouped = spans.groupBy(key).agg(
        F.array_sort(F.collect_list(S.span(*[F.col(c) for c in ("start", "end", "text", "label", "confidence")]))).alias(out)
    )
    return df.join(grouped, key, "left").withColumn(out, F.coalesce(F.col(out), S.no_spans()))


WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_#'’-]*[\p{L}\p{N}_])?"


def gazetteer_spans(df: DataFrame, key: str, col: str, dictionary: DataFrame, language: str | None = None) -> DataFrame:
    """Spans (start, end, text, label, confidence) of dictionary phrases, however many words they have.

    ``dictionary`` has (phrase, label) with lower-case phrases, and ``language`` where a phrase
    counts in texts of that language only, which a column of ``df`` then names.
    """
    return dictionary_spans(df, key, col, dictionary, language)


def phrase_spans(col: Column, phrases: dict[str, Sequence[str]]) -> Column:
    """Gazetteer for short in-code lists: one alternation per label, no explode and no join."""
    patterns = []
    for label, listed in phrases.items():
        options = "|".join(_literal(p) for p in sorted(listed, key=len, reverse=True))
        patterns.append((label, rf"(?i){V.LEFT}(?:{options}){V.RIGHT}"))
    return S.non_overlapping(S.first_wins(S.match_many(col, patterns)))


def _literal(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in phrase)


# ---------------------------------------------------------------- context rules


def context_spans(
    col: Column,
    label: str,
    regex: str,
    prefix: Sequence[str] = (),
    suffix: Sequence[str] = (),
    context: int = 100,
    exceptions: Sequence[str] = (),
    exception_distance: int = 10,
) -> Column:
    """Tokens that match ``regex``, accepted by the words around them in the same sentence.

    With ``prefix`` / ``suffix`` words, one of each given list must stand within
    ``context`` characters before / behind; an exception word within
    ``exception_distance`` characters on either side rejects the match.
    """

    def either(listed: Sequence[str]) -> str:
        return r"(?i)(?:" + "|".join(
            (V.LEFT if w[0].isalnum() else "") + _literal(w) + (V.RIGHT if w[-1].isalnum() else "") for w in listed
        ) + ")"

    sentences = S.match_spans(col, r"(?s)(?=\S).*?(?:[.!?](?=\s)|\z)", "s")

    def in_sentence(s):
        body = s["text"]
        found = S.match_spans(body, r"[^\s,;()]*[^\s,;().!?]", label)

        def accepted(t):
            before = S.piece(body, F.greatest(t["start"] - context, F.lit(0)), t["start"])
            behind = S.piece(body, t["end"], t["end"] + context)
            ok = t["text"].rlike(rf"^(?:{regex})$")
            if prefix:
                ok = ok & before.rlike(either(prefix))
            if suffix:
                ok = ok & behind.rlike(either(suffix))
            if exceptions:
                near_before = S.piece(body, F.greatest(t["start"] - exception_distance, F.lit(0)), t["start"])
                near_behind = S.piece(body, t["end"], t["end"] + exception_distance)
                ok = ok & ~near_before.rlike(either(exceptions)) & ~near_behind.rlike(either(exceptions))
            return ok

        return F.transform(
            F.filter(found, accepted),
            lambda t: S.span(t["start"] + s["start"], t["end"] + s["start"], t["text"], t["label"], t["confidence"]),
        )

    return F.flatten(F.transform(sentences, in_sentence))


# ---------------------------------------------------------------- labels


def entity_type(label: Column) -> Column:
    """Model label, plain or with a B-/I- mark, to entity type; unknown labels become OTHER_ID."""
    plain = F.regexp_replace(label, "^[BI]-", "")
    return F.coalesce(F.element_at(string_map(V.LABEL_TO_TYPE), plain), F.lit(V.UNKNOWN_TYPE))


def map_labels(spans: Column) -> Column:
    """Spans with entity types; spans labelled ``O`` are dropped."""
    return F.transform(
        F.filter(spans, lambda s: s["label"] != "O"),
        lambda s: s.withField("label", entity_type(s["label"])),
    )


def promote_provider(text: Column, spans: Column) -> Column:
    """NAME becomes PROVIDER behind a title or before a credential."""

    def promoted(s):
        before = S.piece(text, F.greatest(s["start"] - V.TITLE_WINDOW, F.lit(0)), s["start"])
        behind = S.piece(text, s["end"], s["end"] + V.CREDENTIAL_WINDOW)
        is_provider = (s["label"] == "NAME") & (before.rlike(V.PROVIDER_TITLE) | behind.rlike(V.PROVIDER_CREDENTIAL))
        return s.withField("label", F.when(is_provider, "PROVIDER").otherwise(s["label"]))

    return F.transform(spans, promoted)


def regex_or_model(
    model: Column,
    default_regex: Column,
    custom_regex: Column | None = None,
    override: bool = False,
    combine: bool = False,
    deny: Sequence[str] = (),
) -> Column:
    """Pattern spans with model spans.

    A custom pattern set replaces the default one, or joins it with ``combine``.
    On overlap model spans win, or pattern spans with ``override``. ``deny`` drops
    labels of pattern spans only.
    """
    if custom_regex is None:
        regex = default_regex
    else:
        regex = S.prefer_first(custom_regex, default_regex) if combine else custom_regex
    regex = S.keep_labels(regex, deny=deny)
    order = (regex, model) if override else (model, regex)
    return S.in_text_order(S.prefer_first(*order))


def merge_chunks(*sources: Column, deny: Sequence[str] = ()) -> Column:
    """Spans of several models; on overlap the source listed first wins; denied labels leave at the end."""
    return S.keep_labels(S.in_text_order(S.prefer_first(*sources)), deny=deny)


def overwrite_tags(tokens: Column, tags: Column, listed: Sequence[str], tag: str) -> Column:
    """Tag of every listed word replaced."""
    return F.zip_with(tokens, tags, lambda w, t: F.when(w.isin(*listed), F.lit(tag)).otherwise(t))


def iob_to_spans(tokens: Column, tags: Column) -> Column:
    """B-/I- tags over token spans to entity spans; a chunk ends where its label does."""

    label = lambda tag: F.regexp_replace(tag, "^[BI]-", "")

    def chunks(pairs):
        size = F.size(pairs)
        tag = lambda i: F.get(pairs, i)["tag"]
        goes_on = lambda p, i: p["tag"].startswith("I-") & (i > 0) & F.coalesce(tag(i - 1) != "O", F.lit(True)) & (label(tag(i - 1)) == label(p["tag"]))
        at = F.transform(pairs, lambda p, i: F.when(F.coalesce(goes_on(p, i), F.lit(False)), -1).otherwise(i))
        begins = F.filter(at, lambda i: i >= 0)  # of chunks and of tokens outside
        return let(begins, lambda begin: F.filter(F.transform(begin, lambda i, k: chunk(pairs, i, F.coalesce(F.get(begin, k + 1), size))), lambda c: c.isNotNull()))

    def chunk(pairs, i, to):
        first, last = F.get(pairs, i), F.get(pairs, to - 1)["tok"]
        parts = F.slice(pairs, i + 1, to - i)["tok"]
        two = F.array_join(F.slice(parts["text"], 1, 2), " ")  # no text where both are null, which is one for those that follow
        text = F.when(to - i == 1, first["tok"]["text"]).otherwise(F.array_join(F.concat(F.array(two), F.slice(parts["text"], 3, to - i)), " "))
        found = S.span(first["tok"]["start"], last["end"], text, label(first["tag"]), F.array_min(parts["confidence"]))
        return F.when(F.coalesce(first["tag"] != "O", F.lit(True)), found)

    # each chunk is made once, when its tokens are known
    return let(F.zip_with(tokens, tags, lambda t, g: F.struct(t.alias("tok"), g.alias("tag"))), chunks)


def validate_types(requested: Sequence[str], known: Sequence[str] = tuple(V.REPLACEMENT_TEXT)) -> list[str]:
    """Requested entity types in canonical case; unknown ones are an error."""
    upper = {k.upper(): k for k in known}
    unknown = [r for r in requested if r.upper() not in upper]
    if unknown:
        raise ValueError(f"unknown entity types {unknown}; known: {sorted(known)}")
    return [upper[r.upper()] for r in requested]


def entity_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.ENTITY_CATALOGUE, "entity_type string, description string, examples array<string>, replacement string")


# ---------------------------------------------------------------- profiles


def label_stats(spans: DataFrame, key: str) -> DataFrame:
    """Spans and documents per label. Two partial aggregations: a frequent label never meets in one task."""
    per_doc = spans.groupBy("label", key).agg(F.count("*").alias("_n"))
    return per_doc.groupBy("label").agg(F.sum("_n").alias("n_entities"), F.count("*").alias("n_docs"))


def pii_profile(df: DataFrame, spans: str, text: str) -> DataFrame:
    """Documents with and without entities, entities, entities per 1,000 characters."""
    n = F.size(spans)
    return df.agg(
        F.count("*").alias("n_docs"),
        F.count_if(n > 0).alias("n_with"),
        F.count_if(n == 0).alias("n_without"),
        F.sum(n).cast("bigint").alias("n_entities"),
        F.round(F.sum(n) * 1000.0 / F.sum(F.length(text)), 6).alias("per_1000_chars"),
    )


def batch_totals(df: DataFrame, spans: str) -> DataFrame:
    """(documents, entities, most, least): documents and entities of a batch, and the entities of the document with most and with fewest."""
    n = F.coalesce(F.size(spans), F.lit(0)).cast("bigint")
    counts = df.select(F.greatest(n, F.lit(0)).alias("n"))
    return counts.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"), F.max("n").alias("most"), F.min("n").alias("least"))


def offsets_table(df: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """Type, score and offsets per record, with the entity count and a preview of the text."""
    from ..functions.text import preview

    return df.select(
        key,
        F.size(spans).alias("entity_count"),
        preview(F.col(text)).alias("text_preview"),
        F.inline_outer(
            F.transform(
                F.col(spans),
                lambda s: F.struct(
                    s["label"].alias("type"),
                    s["confidence"].alias("score"),
                    s["start"].alias("begin_offset"),
                    s["end"].alias("end_offset"),
                ),
            )
        ),
    ).filter(F.col("begin_offset").isNotNull())


