"""Row selection: presence, length, routing, order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_language, word_count
from .scale import global_position



def keep_text(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def text_counts(df: DataFrame, col: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(col).isNull()).alias("n_null"),
        F.count_if(F.col(col).isNotNull()).alias("n_text"),
    )


def keep_any_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """At least one of the columns is not blank."""
    return df.filter(reduce(or_, [F.col(c).isNotNull() & (F.trim(F.col(c)) != "") for c in cols]))


def guard_words(df: DataFrame, col: str, low: int = 4, high: int = 300, out: str = "reason") -> DataFrame:
    """NULL where the word count is in range, else why not."""
    n = word_count(F.col(col))
    return df.withColumn("n_words", n).withColumn(
        out,
        F.when(F.col("n_words") < low, F.lit(f"fewer than {low} words")).when(
            F.col("n_words") > high, F.lit(f"more than {high} words")
        ),
    )


def guard_corpus(df: DataFrame, topics: int, docs: tuple[int, int | None] = (2, None), topic_range: tuple[int, int] = (2, 20), embedding: bool = False) -> DataFrame:
    """Checks document and topic counts; an upper limit of documents only where the caller sets one. Reads at most one row beyond a limit."""
    low, high = docs
    if embedding:
        low = max(low, 3)
    if not topic_range[0] <= topics <= topic_range[1]:
        raise ValueError(f"topics must be {topic_range[0]}..{topic_range[1]}, not {topics}")
    n = df.limit((low if high is None else high) + 1).count()
    if n < low or high is not None and n > high:
        raise ValueError(f"documents must be {low}..{'' if high is None else high}, found {n if high is None or n <= high else 'more'}")
    return df


def route(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a problem; the problem text becomes column ``error``."""
    flagged = df.withColumn("error", problem)
    return flagged.filter(F.col("error").isNull()).drop("error"), flagged.filter(F.col("error").isNotNull())


def record_problem(key: str, text: str) -> Column:
    return F.when(F.col(key).isNull(), "record without id").when(
        F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "empty text"
    )


def insert_after(df: DataFrame, derived: dict[str, str]) -> DataFrame:
    """Each derived column right behind its source."""
    late = set(derived.values())
    order = [x for c in df.columns if c not in late for x in ([c, derived[c]] if c in derived else [c])]
    return df.select(*order)


def slice_rows(df: DataFrame, order: Sequence[Column], first: int, last: int) -> DataFrame:
    """Rows first..last-1 (0-based) of the ordered table, with their position, which is exact at any size."""
    ranked = global_position(df, order, "_pos").withColumn("position", F.col("_pos") - 1).drop("_pos")
    return ranked.filter((F.col("position") >= first) & (F.col("position") < last))


def keep_language(df: DataFrame, cols: Sequence[str], language: str = "en") -> DataFrame:
    """Rows where at least one of the texts is in the language."""
    return df.filter(reduce(or_, [detect_language(F.col(c)) == language for c in cols]))


def language_share(df: DataFrame, cols: Sequence[str], language: str = "en") -> DataFrame:
    hit = reduce(or_, [detect_language(F.col(c)) == language for c in cols])
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(hit).alias("n_kept"),
        F.round(F.count_if(hit) * 100.0 / F.count("*"), 4).alias("percent"),
    )


def sample_rows(df: DataFrame, n: int = 3000) -> DataFrame:
    """First n rows for inspection."""
    return df.limit(n)
