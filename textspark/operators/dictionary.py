"""Dictionary entities: phrases of a table, however many there are and however long they are.

The phrases are dealt by hash to shards of a bounded size. Each shard becomes an Aho-Corasick automaton that
workers build once and run over Arrow batches of texts, so a text is read once for each shard,
is never shuffled, and costs the same for phrases of one word or of twelve.
A phrase counts where it begins and ends with a whole word.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.spans import SPANS_DDL
from .scale import checkpointed

HELD = 4  # automata that a worker keeps between tasks
_BUILT: dict[str, ahocorasick.Automaton] = {}
SHARD_PHRASES = 200_000
SHARD_CHARS = 4_000_000
ROWS = 512  # texts that a worker holds as strings at once
INNER = "#'’-"  # inside a word, as in pii.WORD, but not at its ends


def cleaned(dictionary: DataFrame) -> DataFrame:
    """(phrase, label, language): distinct, without null and empty phrases; no language means every language."""
    language = F.col("language").cast("string") if "language" in dictionary.columns else F.lit(None).cast("string")
    rows = dictionary.select(F.col("phrase").cast("string").alias("phrase"), F.col("label").cast("string").alias("label"), language.alias("language"))
    return rows.where((F.length("phrase") > 0) & F.col("label").isNotNull()).distinct()


def shards(dictionary: DataFrame, phrases: int = SHARD_PHRASES, chars: int = SHARD_CHARS) -> list[Broadcast]:
    """Broadcast rows of each shard; a shard has about ``phrases`` phrases and ``chars`` characters at most.

    All labels of a phrase are in one shard. Only one shard at a time is read by the driver.
    """
    rows = checkpointed(cleaned(dictionary))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("phrase")).alias("c")).first()
    count = max(1, math.ceil(size["n"] / phrases), math.ceil((size["c"] or 0) / chars))
    mine = F.pmod(F.xxhash64("phrase"), F.lit(count))
    context = rows.sparkSession.sparkContext
    parts = ([tuple(r) for r in rows.where(mine == i).collect()] for i in range(count))
    return [context.broadcast(part) for part in parts if part]


def automaton(rows: list[tuple[str, str, str | None]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label, language in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        known = found.get(phrase, None)
        if known is None:
            found.add_word(phrase, (len(phrase), [(label, language)]))
        else:
            known[1].append((label, language))
    found.make_automaton()
    return found


def _built(name: str, shard: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a shard, built once in a worker."""
    if name not in _BUILT:
        while len(_BUILT) >= HELD:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = automaton(shard.value)
    return _BUILT[name]


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] begins where a word begins and ends where one ends."""
    if not (_letter(text[start]) and _letter(text[end - 1])):
        return False
    while start > 0 and text[start - 1] in INNER:
        start -= 1
    while end < len(text) and text[end] in INNER:
        end += 1
    return not (start > 0 and _letter(text[start - 1])) and not (end < len(text) and _letter(text[end]))


def lowered(text: str) -> str:
    """Lower case of the same length: a character with a longer lower case stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def found_in(text: str, phrases: ahocorasick.Automaton, language: str | None = None, by_language: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, label) of every phrase, longest first of those with one start."""
    if not len(phrases):
        return []
    out = set()
    for last, (size, labels) in phrases.iter(lowered(text)):
        start = last + 1 - size
        wanted = [label for label, of in labels if of is None or not by_language or of == language]
        if wanted and whole_words(text, start, last + 1):
            out.update((start, last + 1, label) for label in wanted)
    return sorted(out, key=lambda s: (s[0], -s[1], s[2]))


def _span_column(texts: list[str | None], found: list[list[tuple[int, int, str]]]) -> pa.Array:
    ends, flat = [0], []
    for t, spans in zip(texts, found, strict=True):
        flat += [(s, e, t[s:e], label) for s, e, label in spans]
        ends.append(len(flat))
    columns = [pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
    structs = pa.StructArray.from_arrays([*columns, pa.array([1.0] * len(flat), pa.float64())], names=["start", "end", "text", "label", "confidence"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def spans_of_shard(df: DataFrame, col: str, shard: Broadcast, out: str, language: str | None = None) -> DataFrame:
    """``df`` with the spans of one shard's phrases; a narrow step. Null texts have none."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{col}`").cast("string").alias("_text"), (F.col(f"`{language}`") if language else F.lit(None)).cast("string").alias("_language"))
    schema = given.drop("_text", "_language").schema.add(out, DataType.fromDDL(SPANS_DDL))
    name, by_language = uuid.uuid4().hex, language is not None

    def run(batches):
        phrases = _built(name, shard)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                texts, languages = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
                found = [found_in(t, phrases, of, by_language) if t else [] for t, of in zip(texts, languages, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], _span_column(texts, found)], [*kept, out])

    return given.mapInArrow(run, schema)


def dictionary_spans(df: DataFrame, key: str, col: str, dictionary: DataFrame, language: str | None = None) -> DataFrame:
    """(key, start, end, text, label, confidence) of all phrases, of any number of shards; nothing is shuffled."""
    source = [key, col, *([language] if language else [])]
    rows = df.select(*dict.fromkeys(source))
    parts = []
    for shard in shards(dictionary):
        spans = spans_of_shard(rows, col, shard, "_spans", language)
        parts.append(spans.select(key, F.inline_outer("_spans")).where(F.col("start").isNotNull()))
    if not parts:
        return df.select(key, F.inline(F.array().cast(SPANS_DDL)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_dictionary_spans(df: DataFrame, col: str, dictionary: DataFrame, language: str | None = None, out: str = "spans", key: str | None = None) -> DataFrame:
    """``df`` with the spans of all phrases, by start, longest first.

    A dictionary of one shard is looked up in the row. One of more shards gives a table of spans for each,
    which is joined by ``key``, unique in ``df``.
    """
    from .pii import attach_spans

    parts = shards(dictionary)
    if not parts:
        return df.withColumn(out, F.array().cast(SPANS_DDL))
    if len(parts) == 1:
        return spans_of_shard(df, col, parts[0], out, language)
    if key is None:
        raise ValueError(f"a dictionary of {len(parts)} shards needs the key of the rows")
    found = attach_spans(df, dictionary_spans(df, key, col, dictionary, language), key, out)
    ordered = F.array_sort(out, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    return found.withColumn(out, ordered)
