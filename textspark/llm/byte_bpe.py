"""Byte-level BPE: long texts are encoded in overlapping chunks, stitched where pre-tokens resynchronise.

A text of up to ``CHUNK`` characters is a chunk of its own and stays in its row. A longer one is cut
into chunks that reach ``OVERLAP`` characters into the next one, which are dealt to tasks
and cut into pre-tokens there, each from its own start. Pre-tokens tile a text and where one
starts depends only on what follows, so from the first start that two neighbours share in
their overlap on, both agree. There the text is stitched: what lies between two such places is a
piece, and pieces are encoded independently of each other. Neighbours without a common
start (one pre-token fills the overlap) stay one piece. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspark.llm.common import arrow_map, query, table, with_columns, written

CHUNK = 1 << 15  # characters
OVERLAP = 1 << 10
AHEAD = 3  # characters that decide a pre-token of fixed form ('ll, 're, 've)


class Tokenizer:
    """Ranks of a public vocabulary file, and the pattern of its pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.pattern = regex.compile(pattern)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def starts(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), np.int64)


LOADED: dict[tuple[str, str], Tokenizer] = {}  # one for each vocabulary in a worker


def tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in LOADED:
        LOADED[path, pattern] = Tokenizer(path, pattern)
    return LOADED[path, pattern]


def plain(texts: pa.Array) -> list[str]:
    """Texts as they are; null is empty, bytes that are not UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") if x else "" for x in texts.cast(pa.binary()).to_pylist()]


def stitch(before: np.ndarray, after: np.ndarray, text: str, base: int) -> int:
    """First start that both neighbours have behind a character that is no white space; -1 where there is none.

    White space that ends a text is one pre-token, though it is two before a word; so no
    piece may end in it. A start before white space is taken first: it is one whatever letters are.
    """
    both = [p for p in np.intersect1d(before, after).tolist() if p > base and not text[p - base - 1].isspace()]
    return next((p for p in both if text[p - base] in " \t\n\r"), both[0] if both else -1)


def long_ids(rows: DataFrame, load, chunk: int, overlap: int) -> DataFrame:
    """(_llm_row, ids) of (_llm_row, _llm_text), by chunks: the texts are longer than one."""

    def cut(batch):
        for i in range(batch.num_rows):
            text = plain(batch.column(1).slice(i, 1))[0]
            starts = range(0, max(1, len(text) - overlap), chunk)
            for at in range(0, len(starts), 64):
                part = starts[at : at + 64]
                ends = [len(text) if s == starts[-1] else s + chunk + overlap for s in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(part), pa.int64()), pa.array([s // chunk for s in part], pa.int64()), pa.array([s == starts[-1] for s in part]),
                     pa.array([text[s:e] for s, e in zip(part, ends, strict=True)], pa.string())], ["row", "no", "last", "chunk"])

    def pre_tokens(batch):
        first, behind = [], []
        for no, last, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s = load().starts(text)
            ends = np.append(s[1:], len(text))
            sure = s if last else s[(s + AHEAD <= len(text)) & (ends < len(text))]  # the cut may have changed the others
            first.append(s[s < overlap] + no * chunk if no else s[:0])
            behind.append(sure[sure >= chunk] + no * chunk if not last else s[:0])
        made = [pa.array(x, pa.list_(pa.int64())) for x in (first, behind)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "first", "behind"])

    chunks = arrow_map(rows, cut, "row long, no long, last boolean, chunk string", rows=1).repartition("row", "no")
    cuts = written(arrow_map(chunks, pre_tokens, "row long, no long, last boolean, chunk string, first array<long>, behind array<long>", rows=16), "pre-tokens")
    head = F.substring("chunk", 1, overlap)
    left = cuts.where(~F.col("last")).select("row", (F.col("no") + 1).alias("no"), F.col("behind").alias("before"))
    seams = cuts.where(F.col("no") > 0).select("row", "no", "first", head.alias("head")).join(left, ["row", "no"])

    def meet(batch):
        c = [batch.column(k).to_pylist() for k in range(5)]
        at = [stitch(np.array(b, np.int64), np.array(f, np.int64), h, no * chunk) for _, no, f, h, b in zip(*c, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.int64())], ["row", "no", "at"])

    met = arrow_map(seams, meet, "row long, no long, at long")
    here = F.coalesce("at", F.lit(0))  # the first chunk starts at 0
    of_row = Window.partitionBy("row").orderBy("no")
    pieces = cuts.select("row", "no", "last").join(met, ["row", "no"], "left").withColumn("at", here)
    pieces = pieces.withColumn("piece", F.sum((F.col("at") >= 0).cast("long")).over(of_row)).withColumn("next", F.coalesce(F.lead("at").over(of_row), F.lit(-2)))
    placed = written(pieces.select("row", "no", "piece", "at", "next"), "pieces")
    joined = cuts.select("row", "no", "last", "chunk").join(placed, ["row", "no"])
    base = F.col("no") * chunk
    # a chunk's own part: from its stitch, or its nominal start, to the next one's
    begin = F.when(F.col("at") >= 0, F.col("at")).otherwise(base)
    end = F.when(F.col("next") == -2, F.lit(None)).when(F.col("next") >= 0, F.col("next")).otherwise(base + chunk)
    own = joined.select("row", "piece", "no", "chunk", (begin - base).alias("b"), (end - base).alias("e"))

    def encode(batch):
        c = [batch.column(k).to_pylist() for k in range(3)]
        found = [load().ids("".join(p["chunk"][p["b"] : p["e"]] for p in sorted(parts, key=lambda p: p["no"]))) for parts in c[2]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in found], pa.binary())], ["row", "piece", "ids"])

    parts = own.groupBy("row", "piece").agg(F.collect_list(F.struct("no", "chunk", "b", "e")).alias("parts"))
    encoded = written(arrow_map(parts, encode, "row long, piece long, ids binary", rows=16), "piece-ids")

    def whole(batch):
        ids = [b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["piece"])) for parts in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["_llm_row", "ids"])

    return arrow_map(encoded.groupBy("row").agg(F.collect_list(F.struct("piece", "ids")).alias("parts")), whole, "_llm_row long, ids binary", rows=16)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids``: the token ids as little-endian unsigned 32-bit numbers, as of the whole text at once.

    Null and empty texts have no ids; repeated rows have equal ones. Strings of special tokens are
    ordinary text. A column of the name ids is replaced; others stay as they are.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    load = lambda: tokenizer(path, pattern)
    kept = [c for c in docs.columns if c.lower() != "ids"]
    source = F.col(f"`{text}`").cast("string")

    def run(column):
        return {"ids": pa.array([load().ids(t).tobytes() for t in plain(column)], pa.binary())}

    short = with_columns(docs.where(F.coalesce(F.length(source), F.lit(0)) <= chunk), source, run, {"ids": "binary"})
    long = docs.where(F.length(source) > chunk).select(*[F.col(f"`{c}`") for c in kept], source.alias("_llm_text"), F.monotonically_increasing_id().alias("_llm_row"))
    long = written(long, "long-texts")
    ids = long_ids(long.select("_llm_row", F.col("_llm_text")), load, chunk, overlap)
    done = long.drop("_llm_text").join(ids, "_llm_row").select(*[F.col(f"`{c}`") for c in kept], "ids")
    return short.unionByName(done)


def decoded(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``: the bytes of their ids, joined. Null and empty ids give none; an id that is not in the vocabulary is an error."""
    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(column):
        of = tokenizer(path, pattern).bytes
        return {"decoded": pa.array([b"".join([of[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in column.to_pylist()], pa.binary())}

    return with_columns(rows, F.col(f"`{ids}`"), run, {"decoded": "binary"})


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    length = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", length.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
