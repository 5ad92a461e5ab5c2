"""Language of a text by profiles of characters (Cavnar and Trenkle's rank distance)."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scale import top_k

TOP = 300  # grams of a profile
GRAMS = (1, 2, 3)
KNOWN = 100_000  # words whose grams a worker remembers
ROWS = 512
WORD = r"\p{L}+"
_GRAMS: dict[str, list[str]] = {}
_PROFILES: dict[str, dict[str, dict[str, int]]] = {}


def _grams(word: Column) -> Column:
    """All 1- to 3-grams of a word between marks, but the mark alone."""
    whole = F.concat(F.lit("_"), word, F.lit("_"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), lambda i: F.substring(whole, i, F.lit(n)))

    return F.filter(F.concat(*[of(n) for n in GRAMS]), lambda g: g != "_")


def language_profiles(df: DataFrame, text: str, language: str, top: int = TOP) -> DataFrame:
    """(language, gram, n, rank): the most frequent grams of the texts of each language, ties in the order of the grams.

    Words are counted before they are cut into grams, so the grams of a frequent word are made once a language.
    """
    words = df.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("language", "word").agg(F.count("*").alias("n"))
    grams = counted.select("language", "n", F.explode(_grams(F.col("word"))).alias("gram")).groupBy("language", "gram").agg(F.sum("n").alias("n"))
    return top_k(grams, ["language"], [F.desc("n"), F.asc("gram")], top)


def grams_of(word: str) -> list[str]:
    found = _GRAMS.get(word)
    if found is None:
        if len(_GRAMS) >= KNOWN:
            _GRAMS.clear()
        whole = f"_{word}_"
        found = _GRAMS[word] = [g for n in GRAMS for i in range(len(whole) - n + 1) if (g := whole[i : i + n]) != "_"]
    return found


def nearest(text: str, profiles: dict[str, dict[str, int]], top: int, pattern=regex.compile(WORD)) -> str | None:
    """The language with the smallest sum of rank differences; ties to the first name, None of a text without letters."""
    counts: Counter[str] = Counter()
    for word, n in Counter(pattern.findall(text.lower())).items():
        for g in grams_of(word):
            counts[g] += n
    if not counts or not profiles:
        return None
    # by bytes, as tables are sorted
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top]
    away = {name: sum(abs(ranks.get(g, top + i) - i) for i, (g, _) in enumerate(ranked, 1)) for name, ranks in profiles.items()}
    return min(sorted(away), key=away.__getitem__)


def detect_by_profile(df: DataFrame, text: str, profiles: DataFrame, out: str = "language", min_chars: int = 10, top: int = TOP) -> DataFrame:
    """``df`` with the language of each text, in the row; ``unknown`` for null and short texts and those without letters.

    A gram that a profile does not have is ``top`` ranks away. ``profiles`` has at most ``top`` rows a language.
    """
    listed: dict[str, dict[str, int]] = {}
    for r in profiles.where(F.col("rank") <= top).select("language", "gram", "rank").collect():
        listed.setdefault(r["language"], {})[r["gram"]] = r["rank"]
    shared, name = df.sparkSession.sparkContext.broadcast(listed), uuid.uuid4().hex
    kept = [c for c in df.columns if c.lower() != out.lower()]
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = given.drop("_text").schema.add(out, StringType())

    def run(batches):
        if name not in _PROFILES:
            _PROFILES.clear()
            _PROFILES[name] = shared.value
        of = _PROFILES[name]
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                texts = batch.column(len(kept)).to_pylist()
                found = [(nearest(t, of, top) or "unknown") if t and len(t.strip(" ")) >= min_chars else "unknown" for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, pa.string())], [*kept, out])

    return given.mapInArrow(run, schema)


def keep_language(df: DataFrame, cols: Sequence[str], profiles: DataFrame, language: str = "en") -> DataFrame:
    """Rows with a text in the language in one of the columns."""
    found = df
    for i, c in enumerate(cols):
        found = detect_by_profile(found, c, profiles, f"_language{i}")
    hit = F.lit(False)
    for i in range(len(cols)):
        hit = hit | (F.col(f"_language{i}") == language)
    return found.where(hit).drop(*[f"_language{i}" for i in range(len(cols))])
