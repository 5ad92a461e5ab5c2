"""Quality rules: counts over words, lines and symbols, and perplexity bands of each language.

The language model is a modified Kneser-Ney model of order 4 over code points as they are, so it
grows with the corpus and needs no alphabet. Tasks count the n-grams of blocks of texts, Spark sums
the blocks and computes all probabilities as tables dealt by the hash of the n-gram. A block then
gets the rows of its own n-grams by a join, as sorted arrays, and scores its texts with them;
neither a task nor the driver ever holds the whole model.
The n-grams of a text itself are taken out of the counts of the top order, so it does not vouch
for itself.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import ROWS, new_folder, query, table, texts, with_columns, words, written

ORDER = 4
BITS = 16
LAST = (1 << BITS) - 1
BLOCK = 1 << 25  # bytes of texts whose n-grams are asked for at once
PIECE = 1 << 20  # code points that are cut into n-grams at once
EDGE = 3  # code point that bounds a text
LANGUAGES = 10_000  # tables of one row a language are broadcast up to here
LANGUAGES_HELD = 64  # blocks a task fills at once
REJECTED = 500_000  # keys of rejected texts are broadcast up to here, about 50 MB
MIN_WORDS = 20
REPEAT_SHARE = 30  # per cent of words
WINDOW = 8
WIDTH = 8.0  # median deviations on either side of the median log perplexity
LEAST = 0.2  # half width of a band at least: a language of copies has a deviation of zero
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


class Alphabet:
    """Numbers of 16 bits for the code points of a block, so that an n-gram is one number, its context in the high bits.

    0 bounds a text.
    """

    def __init__(self):
        self.number = np.zeros(0x110000, np.uint16)
        self.points = [EDGE]

    def room(self, data: np.ndarray) -> bool:
        """Numbers for new code points; False, and none, if there are too few left."""
        new = np.unique(data[self.number[data] == 0])
        if len(self.points) + len(new) > LAST + 1:
            return False
        self.number[new] = len(self.points) + np.arange(len(new))
        self.points += new.tolist()
        return True

    def ngrams(self, data: np.ndarray):
        """The n-grams of a text in pieces: one that ends at each code point and one at its end."""
        edge = np.zeros(ORDER - 1, np.uint16)
        last = edge
        for i in range(0, len(data) + 1, PIECE):
            s = np.concatenate([last, self.number[data[i : i + PIECE]], edge[:1] if i + PIECE > len(data) else edge[:0]])
            last = s[len(s) - ORDER + 1 :]
            wide, m = s.astype(np.uint64), len(s) - ORDER + 1
            yield sum(wide[k : m + k] << np.uint64(BITS * (ORDER - 1 - k)) for k in range(ORDER))

    def strings(self, code: np.ndarray) -> list[str]:
        at = code[:, None] >> np.arange(BITS * (ORDER - 1), -1, -BITS, dtype=np.uint64) & np.uint64(LAST)
        whole = np.array(self.points, "<u4")[at].tobytes().decode("utf-32-le")
        return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)]

    def codes(self, grams: list[str]) -> np.ndarray:
        at = self.number[np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)].astype(np.uint64).reshape(-1, ORDER)
        return (at << np.arange(BITS * (ORDER - 1), -1, -BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def points(text: bytes) -> np.ndarray:
    """The code points of a text; that of the edge is read as a replacement character, as are those above the basic plane in a text of over 65,535 different ones."""
    data = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(data) > LAST and len(np.unique(data)) > LAST:
        data = np.where(data > LAST, 0xFFFD, data)
    return np.where(data == EDGE, 0xFFFD, data) if EDGE in data else data


class Counts:
    """Distinct n-grams of a block and how often they occur."""

    def __init__(self, block: int):
        self.block, self.alphabet = block, Alphabet()
        self.code, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> bool:
        """Counts a text; False, and nothing counted, if the alphabet has no room for it."""
        data = points(text)
        if not self.alphabet.room(data):
            return False
        for piece in self.alphabet.ngrams(data):
            self.raw.append(piece)
            self.size += len(piece)
            if self.size >= PIECE:
                self.merge()
        return True

    def merge(self):
        code, n = np.unique(np.concatenate([self.code[:0], *self.raw]), return_counts=True)
        self.raw, self.size = [], 0
        both, at = np.unique(np.concatenate([self.code, code]), return_inverse=True)
        self.code, self.n = both, np.bincount(at, np.concatenate([self.n, n]), len(both)).astype(np.int64)


# ---------------------------------------------------------------- the model


def language(lang: str) -> Column:
    return F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(""))


def by_language(rows: DataFrame) -> DataFrame:
    """A table of one row a language, broadcast if these are few."""
    rows = written(rows, "languages")
    return F.broadcast(rows) if rows.count() <= LANGUAGES else rows


def bucketed(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, in buckets of ``key``: groups of it are read where they lie, so their rows are not shuffled again."""
    spark, buckets = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = f"llm_{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).saveAsTable(at, format="parquet", path=new_folder(spark, name))
    return spark.table(at)


def blocked(docs: DataFrame) -> DataFrame:
    """Rows of texts (block, doc_id, lang, body: the compressed text, the counts) and rows of n-grams (block, lang, gram, n).

    A block has texts of one language of one task, about ``BLOCK`` bytes of all languages at a
    time, and each of their n-grams once, in order.
    """
    names = ["block", "lang", "doc_id", "body", *BASE, "gram", "n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, lang string, doc_id {kind}, body binary, {', '.join(f'{c} long' for c in BASE)}, gram string, n long"

    def run(batches):
        given, held, size, number = TaskContext.get().partitionId() << 32, {}, 0, 0

        def flush(name, kind):
            counts = held.pop(name)
            counts.merge()
            for i in range(0, len(counts.code), 1 << 16):
                code = counts.code[i : i + (1 << 16)]
                m = len(code)
                empty = [pa.nulls(m, kind), pa.nulls(m, pa.binary()), *[pa.nulls(m, pa.int64())] * len(BASE)]
                grams = pa.array(counts.alphabet.strings(code), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, counts.block)), pa.array([name] * m, pa.string()), *empty, grams, pa.array(counts.n[i : i + (1 << 16)])], names)

        for whole in batches:
            kind = whole.column(0).type
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                bodies, of = texts(batch.column(2)), []
                for name, t in zip(batch.column(1).to_pylist(), bodies, strict=True):
                    if name not in held or not held[name].add(t):
                        if name in held:
                            yield from flush(name, kind)
                        held[name], number = Counts(given + number), number + 1
                        held[name].add(t)
                    of.append(held[name].block)
                    size += len(t)
                m, base, packed = batch.num_rows, base_counts(bodies), zstandard.ZstdCompressor()
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), batch.column(1), batch.column(0), pa.array([packed.compress(t) for t in bodies], pa.binary()), *[base[c] for c in BASE], pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names)
                if size >= BLOCK or len(held) > LANGUAGES_HELD:
                    for name in list(held):
                        yield from flush(name, kind)
                    size = 0
        for name in list(held):
            yield from flush(name, kind)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3, kinds) from how many n-grams are seen once to four times; kinds is how many there are."""
    by = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
    # every discount stays within [0, k], also where counts of counts are zero
    d = [
        F.when(F.col(f"n{k}") > 0, F.least(F.lit(float(k)), F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(0.5)).alias(f"d{k}")
        for k in (1, 2, 3)
    ]
    return counts.groupBy("lang").agg(*by, F.count("*").alias("kinds")).select("lang", *d, "kinds")


def discount() -> Column:
    return F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))


def model(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, n, total, left, lower) of each n-gram of the top order in (lang, gram, n), and the discounts of its order.

    ``total`` and ``left`` are the count of its context and what the discounts leave to shorter
    n-grams, ``lower`` the interpolated probability of its suffix. Shorter n-grams count the
    different code points that stand before them; below the shortest all code points of the
    language and an unknown one are equally likely.
    """
    top = written(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    levels = [top]
    for _ in range(ORDER - 1):
        levels.append(written(levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "ngrams"))
    below = offs = None
    for k, counts in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        offs = by_language(discounts(counts))
        context = F.col("gram").substr(F.lit(1), F.lit(k - 1)).alias("context")
        seen = [F.sum(F.when(F.col("n") == j if j < 3 else F.col("n") >= j, 1).otherwise(0)).alias(f"c{j}") for j in (1, 2, 3)]
        per = counts.groupBy("lang", context).agg(F.sum("n").alias("total"), *seen)
        cut = counts.select("*", context).join(per, ["lang", "context"]).join(offs, "lang")
        cut = cut.withColumn("left", sum((F.col(f"c{j}") * F.col(f"d{j}") for j in (2, 3)), F.col("c1") * F.col("d1")))
        if below is None:
            cut = cut.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            cut = cut.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["lang", "suffix"])
        if k == ORDER:
            return cut.select("lang", "gram", "n", "total", F.col("left").cast("float"), F.col("lower").cast("float")), offs.drop("kinds")
        p = (F.col("n") - discount() + F.col("left") * F.col("lower")) / F.col("total")
        below = written(cut.select("lang", "gram", p.alias("p")), "orders")


ANSWERS = ["gram", "n", "total", "left", "lower"]


class Scorer:
    """The n-grams of a block as sorted arrays."""

    def __init__(self, rows: pa.Table):
        grams, self.alphabet = rows.column("gram").to_pylist(), Alphabet()
        self.alphabet.room(points("".join(grams).replace(chr(EDGE), "").encode()))
        code = self.alphabet.codes(grams)
        order = np.argsort(code)
        self.code = code[order]
        self.n, self.total, self.left, self.lower = (rows.column(c).to_numpy()[order] for c in ANSWERS[1:])

    def log_perplexity(self, text: bytes, off: np.ndarray) -> float:
        """Mean negative log probability of the n-grams of a text, whose own n-grams do not count in the top order."""
        own = Counts(0)
        own.alphabet = self.alphabet
        own.add(text)
        own.merge()
        at = np.searchsorted(self.code, own.code)
        context = own.code >> np.uint64(BITS)
        new = np.concatenate([[True], context[1:] != context[:-1]])
        n = self.n[at] - own.n
        total = self.total[at] - np.add.reduceat(own.n, np.flatnonzero(new))[np.cumsum(new) - 1]
        known = np.maximum(total, 1)
        lower = self.lower[at].astype(np.float64)
        rest = np.where(total > 0, np.minimum(1.0, self.left[at] / known), 1.0)
        p = np.where(total > 0, np.maximum(n - off[np.clip(n, 0, 3)], 0) / known, 0) + rest * lower
        return float(-(own.n * np.log(np.minimum(p, 1.0))).sum() / own.n.sum())


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the counts, base_failed, log_perplexity) of each row of (doc_id, lang, text)."""
    rows = bucketed(blocked(docs), "blocks", "block")
    grams = rows.where(F.col("gram").isNotNull()).select("block", "lang", "gram", "n")
    trained, offs = model(grams.select("lang", "gram", "n"))
    answers = grams.select("block", "lang", "gram").join(trained, ["lang", "gram"]).select(F.col("block").alias("asked"), *ANSWERS)
    bodies = rows.where(F.col("gram").isNull()).drop("gram", "n").join(offs, "lang")
    out = ["doc_id", "lang", *BASE]

    def score(body: pa.Table, answer: pa.Table) -> pa.Table:
        body, scorer = body.combine_chunks(), Scorer(answer)
        off = np.array([0.0, *[body.column(f"d{j}")[0].as_py() for j in (1, 2, 3)]])
        values, packed = [], zstandard.ZstdDecompressor()
        for i in range(0, body.num_rows, ROWS):
            values += [scorer.log_perplexity(packed.decompress(t), off) for t in body.column("body").slice(i, ROWS).to_pylist()]
        return body.select(out).append_column("log_perplexity", pa.array(values, pa.float64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in BASE)}, log_perplexity double"
    scored = bodies.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(score, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return scored.withColumn("base_failed", failed)


# ---------------------------------------------------------------- counts and verdicts


def repeated_words(tokens: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that are in the text twice or more; compared exactly, by doubling the width."""
    if len(tokens) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids, width = np.array([number.setdefault(w, len(number)) for w in tokens], np.int64), 1
    often = np.bincount(ids)[ids] > 1
    while width < WINDOW:  # a window can only be there twice if both its halves are
        at = np.flatnonzero(often[:-width] & often[width:])
        if not len(at):
            return 0
        _, own, n = np.unique(ids[at] * len(tokens) + ids[at + width], return_inverse=True, return_counts=True)
        ids, often = ids[:-width].copy(), np.zeros(len(ids) - width, bool)
        ids[at], often[at] = own, n[own] > 1
        width *= 2
    again = np.flatnonzero(often)
    step = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(bodies: list[bytes]) -> dict[str, pa.Array]:
    rows = []
    for t in bodies:
        data = np.frombuffer(t, np.uint8)
        tokens = words(t)
        lines = [x for x in t.split(b"\n") if x.strip()]
        starts = (data & 0xC0) != 0x80
        rows.append((len(tokens), int((starts & ~SPACE[data]).sum()), int(SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated_words(tokens)))
    return {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(BASE)}


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high): the median log perplexity of rows that pass the base rules, plus and minus ``WIDTH`` median deviations."""
    sound = rows.where(~F.col("base_failed")).select("lang", "log_perplexity")
    middle = by_language(sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle")))
    off = sound.join(middle, "lang").groupBy("lang", "middle").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000).alias("off"))
    half = F.greatest(F.lit(LEAST), WIDTH * F.col("off"))
    return by_language(off.select("lang", (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high")))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, the counts, base_failed, log_perplexity, low, high, kept) for each row.

    The model and the bands come from all rows of ``docs``. A null text has no words and fails; a
    null language is one of its own; equal rows get equal verdicts; an empty table stays empty. A
    language none of whose rows passes the base rules has no band, and none is needed.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), language(lang).alias("lang"), F.col(f"`{text}`").alias("text"))
    rows = written(measured(docs), "measured")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.join(bands(rows), "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def row_keys(column: pa.Array) -> dict[str, pa.Array]:
    """128 bits of language and text, of which the verdict is a function."""
    langs, bodies = column.flatten()
    keys = [xxhash.xxh3_128_digest(b"%d %b %b" % (len(x), x, t)) for x, t in zip(texts(langs), texts(bodies), strict=True)]
    return {"_llm_key": pa.array(keys, pa.binary())}


def kept(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns as they are."""
    keyed = with_columns(docs, F.struct(language(lang).alias("l"), F.col(f"`{text}`").alias("t")), row_keys, {"_llm_key": "binary"})
    verdicts = judged(keyed, "_llm_key", text, lang)
    rejected = written(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_llm_key")).distinct(), "rejected")
    if rejected.count() <= REJECTED:  # else the texts are shuffled
        rejected = F.broadcast(rejected)
    return keyed.join(rejected, "_llm_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "log_perplexity", "kept")
