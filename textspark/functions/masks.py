"""Replacement texts for spans and masks for whole columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..resources import values as V
from .expr import seeded_index, string_array, string_map

Replacement = Callable[[Column], Column]

# ---------------------------------------------------------------- span replacements


def label_text(s: Column) -> Column:
    return F.concat(F.lit("["), s["label"], F.lit("]"))


def placeholder(s: Column) -> Column:
    """Text of the entity catalogue, else the label in brackets."""
    return F.coalesce(F.element_at(string_map(V.REPLACEMENT_TEXT), s["label"]), label_text(s))


def single_text(value: str) -> Replacement:
    return lambda s: F.lit(value)


def blocks(s: Column) -> Column:
    return F.repeat(F.lit("█"), F.length(s["text"]))


def hashed(s: Column) -> Column:
    return F.concat(F.lit("["), s["label"], F.lit("_"), F.substring(F.sha2(s["text"], 256), 1, 8), F.lit("]"))


def custom(mapping: dict[str, str]) -> Replacement:
    return lambda s: F.coalesce(F.element_at(string_map(mapping), s["text"]), placeholder(s))


def angle_label(s: Column) -> Column:
    return F.concat(F.lit("<"), s["label"], F.lit(">"))


def same_length(s: Column) -> Column:
    n = F.length(s["text"])
    return F.when(n > 2, F.concat(F.lit("["), F.repeat(F.lit("*"), n - 2), F.lit("]"))).otherwise(
        F.repeat(F.lit("*"), n)
    )


def fixed_length(n: int = 4) -> Replacement:
    return lambda s: F.lit("*" * n)


def wrap(before: str, after: str) -> Replacement:
    return lambda s: F.concat(F.lit(before), s["text"], F.lit(after))


def from_pool(pools: dict[str, Sequence[str]] = V.POOLS, seed: int | str = 42, key: Replacement | None = None) -> Replacement:
    """Fake value of the same label; the pick depends on (text, seed) only, so equal texts agree everywhere.

    Labels without a pool fall back to the label in brackets.
    """

    def pick(s: Column) -> Column:
        basis = key(s) if key else s["text"]
        out = label_text(s)
        for label, options in pools.items():
            out = F.when(
                s["label"] == label,
                F.element_at(string_array(options), seeded_index(basis, seed, len(options)) + 1),
            ).otherwise(out)
        return out

    return pick


def merge_pools(source: str, reference: dict[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """``file``: the reference list only; ``faker``: the built-in pools only; ``both``: joined per label."""
    reference = reference or {}
    if source == "file":
        return {k: list(v) for k, v in reference.items()}
    if source == "faker":
        return {k: list(v) for k, v in V.POOLS.items()}
    if source == "both":
        return {k: [*V.POOLS.get(k, []), *reference.get(k, [])] for k in [*V.POOLS, *[r for r in reference if r not in V.POOLS]]}
    raise ValueError(f"unknown source {source!r}: use file, faker or both")


def by_label(modes: dict[str, Sequence[str]], default: Replacement, actions: dict[str, Replacement]) -> Replacement:
    """Different treatment per label (any case); labels not listed get ``default``."""

    def choose(s: Column) -> Column:
        out = default(s)
        for mode, labels in modes.items():
            if labels:
                out = F.when(F.upper(s["label"]).isin(*[x.upper() for x in labels]), actions[mode](s)).otherwise(out)
        return out

    return choose


def keep(s: Column) -> Column:
    return s["text"]


STRATEGIES: dict[str, Replacement] = {
    "placeholder": placeholder,
    "redact": blocks,
    "hash": hashed,
    "label": label_text,
    "entity_labels": angle_label,
    "same_length_chars": same_length,
}

MODE_ACTIONS: dict[str, Replacement] = {
    "obfuscate": from_pool(),
    "mask_entity_labels": angle_label,
    "mask_same_length_chars": same_length,
    "mask_fixed_length_chars": fixed_length(4),
    "skip": keep,
}

# ---------------------------------------------------------------- numbered pseudonyms


def pseudonym(label: Column, number: Column) -> Column:
    """Value formula of consistent pseudonyms: type and running number decide."""
    n = number.cast("bigint")
    pad = lambda x, w: F.when(F.length(x.cast("string")) >= w, x.cast("string")).otherwise(F.lpad(x.cast("string"), w, "0"))
    ten = (F.pmod(n, F.lit(10)) + 1).cast("int")
    first, last = F.element_at(string_array(V.FAKE_FIRST), ten), F.element_at(string_array(V.FAKE_LAST), ten)
    return (
        F.when(label == "NAME", F.concat(first, F.lit(" "), last))
        .when(label == "DATE", F.concat(pad(F.pmod(n, F.lit(12)) + 1, 2), F.lit("/"), pad(F.pmod(n, F.lit(28)) + 1, 2), F.lit("/XXXX")))
        .when(label == "PHONE", F.concat(F.lit("555-"), pad(n, 3), F.lit("-"), pad(n + 1000, 4)))
        .when(label == "EMAIL", F.concat(F.lower(last), n.cast("string"), F.lit("@example.com")))
        .when(label == "SSN", F.lit("XXX-XX-XXXX"))
        .when(label == "MRN", F.concat(F.lit("MRN-"), pad(n, 8)))
        .when(label == "AGE", F.lit("[AGE>89]"))
        .otherwise(F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]")))
    )


# ---------------------------------------------------------------- dates and ages

DATE_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "MM/dd/yyyy"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", "yyyy-MM-dd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", "MM-dd-yyyy"),
    (rf"^(?:{V.MONTHS})\s+\d{{1,2}}\s+\d{{4}}$", "MMMM d yyyy", "MMMM d yyyy"),
    (rf"^(?:{V.MONTHS})\s+\d{{1,2}},\s*\d{{4}}$", "MMMM d, yyyy", "MMMM d, yyyy"),
)
DAY_FIRST_FORMATS = ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", "dd/MM/yyyy"),)


def shift_date(text: Column, days: Column, formats: Sequence[tuple[str, str, str]] = DATE_FORMATS) -> Column:
    """Date in text moved by ``days`` and printed in its own format; NULL when it cannot be parsed."""
    out = F.lit(None).cast("string")
    for shape, reading, writing in formats:
        # a written date has one blank between its parts, and one behind a comma
        plain = F.regexp_replace(F.regexp_replace(text, r",\s*", ", "), r"\s+", " ") if "MMMM" in reading else text
        parsed = F.when(text.rlike(shape), F.try_to_date(plain, reading))
        out = F.coalesce(out, F.date_format(F.date_add(parsed, days.cast("int")), writing))
    return out


def patient_shift(patient: Column, days: int, seed: int | str) -> Column:
    """Shift in -days..days, a function of (patient, seed)."""
    return seeded_index(patient.cast("string"), seed, 2 * days + 1) - days


def age_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{1,3})", 1), F.lit("")).cast("int")


def age_group(text: Column, groups: dict[str, tuple[int, int]] = V.AGE_GROUPS) -> Column:
    """Name of the group low <= age < high, else the last group; text without a number stays."""
    n = age_number(text)
    out = F.when(n.isNotNull(), F.lit(list(groups)[-1])).otherwise(text)
    for name, (low, high) in reversed(groups.items()):
        out = F.when((n >= low) & (n < high), F.lit(name)).otherwise(out)
    return out


def age_in_range(text: Column, bounds: Sequence[int] = V.AGE_RANGES, seed: int | str = 42) -> Column:
    """Another age of the same range (b[i-1], b[i]]; the last range is open and 40 years wide."""
    n = age_number(text)
    edges = [0, *bounds, bounds[-1] + 40]
    number = F.lit(None).cast("int")
    for low, high in zip(edges, edges[1:]):
        pick = F.lit(low + 1) + seeded_index(text, seed, high - low)
        number = F.when((n > low) & (n <= high), pick).otherwise(number)
    return F.when(number.isNull(), text).otherwise(F.regexp_replace(text, F.lit(r"\d{1,3}"), number.cast("string")))


def age_hipaa(text: Column, limit: int = 89, replacement: str = "[AGE>89]") -> Column:
    """Only ages above the limit change."""
    return F.when(age_number(text) > limit, F.lit(replacement)).otherwise(text)


# ---------------------------------------------------------------- whole columns


def mask_all(col: Column, char: str = "#") -> Column:
    return F.repeat(F.lit(char), F.length(col.cast("string")))


def mask_part(col: Column, char: str, first: bool, n: int) -> Column:
    """First or last n characters masked; fewer when the value is shorter, none for n = 0."""
    text = col.cast("string")
    hidden = F.least(F.length(text), F.lit(n))
    bar = F.repeat(F.lit(char), hidden)
    if first:
        return F.concat(bar, F.substring(text, hidden + 1, F.length(text)))
    return F.concat(F.substring(text, F.lit(1), F.length(text) - hidden), bar)


def hash_text(col: Column, salt: str | None = None) -> Column:
    text = col.cast("string")
    return F.sha2(text if salt is None else F.concat(text, F.lit(salt)), 256)


# ---------------------------------------------------------------- patterns and keywords without spans


def regex_redact(col: Column, patterns: Sequence[tuple[str, str]] = V.STRUCTURED_PATTERNS) -> Column:
    """Ordered substitution of every pattern by its label in brackets."""
    for label, pattern in patterns:
        col = F.regexp_replace(col, pattern, f"[{label}]")
    return col


def keyword_pattern(keyword: Column) -> Column:
    """Whole-word, any-case pattern of a literal phrase."""
    escaped = F.regexp_replace(keyword, r"([\\.\[\]{}()*+?^$|\-#&~\s])", r"\\$1")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), escaped, F.lit(r"(?![\p{L}\p{N}_])"))


def longest_first(keywords: Column) -> Column:
    return F.array_sort(
        keywords,
        lambda a, b: F.when(F.length(a) > F.length(b), -1)
        .when(F.length(a) < F.length(b), 1)
        .when(a < b, -1)
        .when(a > b, 1)
        .otherwise(0),
    )


def keyword_redact(text: Column, keywords: Column, replacement: str = "[REDACTED]") -> Column:
    """Each keyword, longest first, whole word and any case, replaced."""
    usable = F.filter(F.coalesce(keywords, string_array([])), lambda k: F.length(k) > 0)
    return F.aggregate(
        longest_first(usable), text, lambda acc, k: F.regexp_replace(acc, keyword_pattern(k), F.lit(replacement))
    )
