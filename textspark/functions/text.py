"""Cleaning, tokenising and counting text as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..resources import values as V
from .expr import let, string_array
from .spans import match_spans

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
LINKISH = r"(?i)^(?:https?://|www\.)\S+$|^\S+@\S+\.\S+$"


# ---------------------------------------------------------------- cleaning


def lower_clean(col: Column, punctuation: str = V.PUNCTUATION) -> Column:
    """Lower case without the listed punctuation, trimmed; blank becomes NULL."""
    bare = F.btrim(F.translate(F.lower(col), punctuation, ""), F.lit(V.WHITE))
    return F.nullif(bare, F.lit(""))


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def clean_text(col: Column) -> Column:
    """Lower case, no URLs or e-mail addresses, only [a-z0-9], single blanks."""
    out = F.lower(col)
    for pattern, new in ((r"http\S+|www\S+", ""), (r"\S+@\S+", ""), (r"[^a-z0-9\s]", " ")):
        out = F.regexp_replace(out, pattern, new)
    return squeeze(out)


def truncate(col: Column, n: int) -> Column:
    """First n characters: the limit of the scoring services, applied only where a caller asks for it."""
    return F.substring(col, 1, n)


def preview(col: Column, n: int = 50) -> Column:
    return F.concat(F.substring(F.coalesce(col, F.lit("")), 1, n), F.lit("..."))


def word_count(col: Column) -> Column:
    trimmed = F.trim(col)
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, r"\s+"))).otherwise(0)


def join_terms(col: Column, empty: str | None = "") -> Column:
    return F.when(F.coalesce(F.size(col), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.concat_ws(" ", col))


# ---------------------------------------------------------------- splitting


def words(col: Column) -> Column:
    """Blank-separated pieces of the trimmed text."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def tokens(col: Column) -> Column:
    """Words and single punctuation marks in text order."""
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def token_spans(col: Column) -> Column:
    """Tokens with their offsets."""
    return match_spans(col, TOKEN, "token")


def sentences(col: Column) -> Column:
    """Split behind . ! ? where white space follows."""
    return F.split(col, r"(?<=[.!?])\s+", -1)


def sentence_spans(col: Column) -> Column:
    """Sentences with their offsets, blank ones left out."""
    return match_spans(col, r"(?s)(?=\S).*?(?:[.!?](?=\s)|\z)", "sentence")


def normalise_tokens(col: Column) -> Column:
    """Letters only, lower case, empty ones dropped."""
    return F.filter(
        F.transform(col, lambda t: F.lower(F.regexp_replace(t, r"[^A-Za-z]", ""))), lambda t: t != ""
    )


def remove_stops(col: Column, stop_words: Sequence[str] = V.STOP_WORDS, extra: Sequence[str] = (), min_length: int = 0):
    """Drop listed words (any case) and, with ``min_length``, words that are shorter."""
    listed = [w.lower() for w in [*stop_words, *extra]]
    return F.filter(col, lambda t: ~F.lower(t).isin(*listed) & (F.length(t) >= min_length))


def content_tokens(col: Column, extra: Sequence[str] = ()) -> Column:
    """Lower-case tokens that are no stop word, punctuation, number or extra word and longer than one letter."""
    dropped = [w.lower() for w in [*V.STOP_WORDS, *extra]]
    # only words are extracted: marks are no content, and dropping them one by one costs more than all the rest
    return F.filter(
        F.transform(F.regexp_extract_all(col, F.lit(WORD), F.lit(0)), lambda t: F.lower(t)),
        lambda t: (F.length(t) > 1) & ~t.isin(*dropped) & ~t.rlike(r"^[0-9]+$"),
    )


def normalised_words(col: Column, stop_words: Sequence[str] = V.STOP_WORDS) -> Column:
    """Words without punctuation, stop words left out."""
    return remove_stops(words(F.regexp_replace(col, r"[^\p{L}\p{N}_\s]", "")), stop_words)


def normalise(col: Column, stop_words: Sequence[str] = V.STOP_WORDS) -> Column:
    """Without punctuation and stop words, joined by blanks."""
    return F.coalesce(F.concat_ws(" ", normalised_words(col, stop_words)), F.lit(""))


def kept_and_removed(col: Column, stop_words: Sequence[str] = V.STOP_WORDS) -> tuple[Column, Column]:
    """Text of kept pieces, and text of removed ones (stop words, punctuation, links, addresses)."""
    pieces = F.regexp_extract_all(
        squeeze(col), F.lit(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0)
    )
    listed = [w.lower() for w in stop_words]

    def drop(t):
        return F.lower(t).isin(*listed) | ~t.rlike(WORD) | t.rlike(LINKISH)

    return (
        F.array_join(F.filter(pieces, lambda t: ~drop(t)), " "),
        F.array_join(F.filter(pieces, drop), " "),
    )


# ---------------------------------------------------------------- stems, n-grams, tags


def stem(token: Column) -> Column:
    """Suffix rules: plural, past and progressive endings, then common derivations."""
    out = F.lower(token)
    for pattern, new in (
        (r"sses$", "ss"),
        (r"ies$", "i"),
        (r"(?<=[^s])s$", ""),
        (r"(?<=[a-z]{3})(?:ed|ing|ly)$", ""),
        (r"(?<=[a-z]{3})ation$", "ate"),
        (r"(?<=[a-z]{3})ness$", ""),
    ):
        out = F.regexp_replace(out, pattern, new)
    return out


def ngrams(col: Column, n: int, delimiter: str = "_", cumulative: bool = True) -> Column:
    """n-grams by length, then position; with ``cumulative`` all lengths from 1 to n."""

    def of(arr: Column) -> Column:
        def of_length(k: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(arr) - k + 1, F.lit(1)))
            grams = F.transform(starts, lambda i: F.array_join(F.slice(arr, i, F.lit(k)), delimiter))
            return F.when(F.size(arr) >= k, grams).otherwise(string_array([]))

        return F.concat(*[of_length(k) for k in range(1 if cumulative else n, n + 1)])

    return let(col, of)


def pos_tag(token: Column, known: Column | None = None) -> Column:
    """Tag by lexicon where known, else by suffix rules."""
    low = F.lower(token)
    guess = (
        F.when(~token.rlike(r"[\p{L}\p{N}]"), "PUNCT")
        .when(token.rlike(r"^[0-9][0-9.,]*$"), "CD")
        .when(low.rlike("ly$"), "RB")
        .when(low.rlike("ing$"), "VBG")
        .when(low.rlike("ed$"), "VBD")
        .when(low.rlike("(?:ous|ful|able|ible|ive|al|ic)$"), "JJ")
        .when(low.rlike("(?:tion|ment|ness|ity|ship)$"), "NN")
        .when(low.rlike("s$"), "NNS")
        .otherwise("NN")
    )
    return guess if known is None else F.coalesce(known, guess)


def filter_pos(tokens_col: Column, tags: Column, keep: Sequence[str] = V.UNIGRAM_TAGS) -> Column:
    """Tokens whose tag (same position) is in the list."""
    # the tags are bound once: inside the lambda they would be made again for each token
    return let(tags, lambda own: F.filter(tokens_col, lambda t, i: F.coalesce(F.get(own, i).isin(*keep), F.lit(False))))


def filter_pos_ngrams(grams: Column, tag_grams: Column) -> Column:
    """Bigrams ending in adjective or noun and trigrams ending in a noun, all parts from the kept tags."""
    kept, last = ("JJ", "NN", "NNS", "VB", "VBP"), ("NN", "NNS")
    allowed = [f"{a}_{b}" for a in kept for b in ("JJ", *last)] + [f"{a}_{b}_{c}" for a in kept for b in kept for c in last]
    return let(tag_grams, lambda own: F.filter(grams, lambda g, i: F.coalesce(F.get(own, i).isin(*allowed), F.lit(False))))


def detect_language(col: Column, profiles: dict[str, Sequence[str]] = V.LANGUAGE_WORDS, min_chars: int = 10) -> Column:
    """Language whose frequent words occur most often; ``unknown`` for short texts or without any hit."""
    names = list(profiles)

    def best(ws: Column) -> Column:
        def hits(listed: Sequence[str]) -> Column:
            return F.size(F.filter(ws, lambda w: w.isin(*listed)))

        counts = F.array(*[hits(profiles[n]) for n in names])
        return let(
            counts,
            lambda c: F.when(F.array_max(c) > 0, F.element_at(string_array(names), F.array_position(c, F.array_max(c)).cast("int"))).otherwise("unknown"),
        )

    guess = let(F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), F.lit(0)), best)
    return F.when(F.length(F.trim(col)) >= min_chars, guess).otherwise("unknown")


def distinct_terms(terms: Column) -> Column:
    """Distinct elements in the order in which they first occur."""
    return F.array_distinct(terms)


def final_terms(*arrays: Column) -> Column:
    """Arrays one after the other; a null array has nothing to add."""
    return F.concat(*[F.coalesce(a, string_array([])) for a in arrays])


def visible_tags(tags: Column, hidden: Sequence[str] = V.HIDDEN_TAGS) -> Column:
    """Tags that tables show: without those of marks, function words and unknown words."""
    return F.filter(tags, lambda t: ~t.isin(*hidden))
