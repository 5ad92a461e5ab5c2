"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``SLOTS`` terms. Spark counts in how many passages of the whole corpus each
term occurs. A randomised SVD of the TF-IDF passages, all of the corpus and of the benchmark, runs
as a distributed subspace iteration: tasks sum their part of A'(AV), the sum is orthonormalised,
and so on. All windows of all documents are then projected and compared
by cosine with the benchmark, which is taken in blocks of ``BLOCK`` pieces. What is near is
checked word by word: longest common subsequence, and for looser matches whether the rare words
of the item, its answer, are there. Items of fewer than ``SHORTEST`` words say too little for
that; they match where all their words stand in order, without others in between.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textspark.llm.common import ROWS, arrow_map, query, table, texts, with_columns, written

SLOTS = 1 << 15
RANK = 96
SKIP = 8  # first directions left out of the cosine: they tell languages and styles apart, not contents
PER_SKIP = 128  # one fewer for each so many passages that are not there: few passages have no directions to spare
STEPS = 3  # subspace iterations
SAMPLE = 1 << 14  # passages that a task multiplies at once; all are taken
SLICE = 2048  # entries of them that are added up at once
TASK = 1 << 19  # passages for a task
PASSAGE = 32
UNIT = 4  # words
SCALES = (8, 16, 32, 64)  # words of a window
SHORTEST = 8  # an item of fewer words is looked for as a phrase
PIECE = 64
BLOCK = 4096
NEAR = 0.4  # cosine of a candidate
SAME = 0.7  # share of an item's words in the common subsequence
LIKE = 0.5  # the same for a paraphrase, which also has to have
ANSWER = 0.8  # this share of the item's weight of distinct words
CHUNK = 1 << 16

MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_list(text: bytes) -> list[bytes]:
    """Words without capitals and ASCII marks."""
    return text.decode("utf-8", "replace").lower().encode().translate(MARKS).split()


def slots(tokens: list[bytes]) -> np.ndarray:
    """Term number of each word."""
    return np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)).astype(np.int64) % SLOTS


# ---------------------------------------------------------------- statistics and directions


def cut_up(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of each passage, how often each is in it, and how many each passage has."""
    of_text = [slots(word_list(t)) for t in bodies]
    n = np.array([len(s) for s in of_text], np.int64)
    count = -(-n // PASSAGE)
    passage = np.repeat(np.cumsum(count) - count, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) // PASSAGE
    both, times = np.unique(passage * SLOTS + np.concatenate([*of_text, np.zeros(0, np.int64)]), return_counts=True)
    return (both % SLOTS).astype("<u2"), times.astype(np.uint8), np.bincount(both // SLOTS, minlength=count.sum()).astype(np.uint8)


def passages(rows: DataFrame) -> DataFrame:
    """(slots, times, sizes): all passages of all texts, at most ``SAMPLE`` in a row; written once."""
    names = ["slots", "times", "sizes"]

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                held.append(cut_up(texts(batch.column(0).slice(i, ROWS))))
                count += len(held[-1][2])
                if count >= SAMPLE:
                    *full, rest = parted(held)
                    yield from full
                    held, count = [rest], len(rest[2])
        if count:
            yield from parted(held)

    def parted(held):
        s, times, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for lo in range(0, len(sizes), SAMPLE):
            own = slice(ends[lo], ends[min(lo + SAMPLE, len(sizes))])
            yield s[own], times[own], sizes[lo : lo + SAMPLE]

    def packed(batches):
        for row in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names)

    return written(rows.select("text").mapInArrow(packed, "slots binary, times binary, sizes binary"), "passages")


def passage_counts(docs: DataFrame, cut: DataFrame | None = None) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each term occurs, and how many passages there are: ``SLOTS`` + 1 sums."""

    def run(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for s, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[:SLOTS] += np.bincount(np.frombuffer(s, "<u2"), minlength=SLOTS)
                total[SLOTS] += len(sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    cut = passages(docs) if cut is None else cut
    rows = cut.select("slots", "sizes").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS + 1, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return out[:SLOTS], int(out[SLOTS])


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray, weight: np.ndarray) -> None:
    """Adds ``weight`` times the rows ``of`` to the rows ``at``, which are in order; little at a time, so that it stays in the cache."""
    for i in range(0, len(at), SLICE):
        part = at[i : i + SLICE]
        first = runs(part)
        to[part[first]] += np.add.reduceat(rows[of[i : i + SLICE]] * weight[i : i + SLICE, None], first)


def add_image(total: np.ndarray, basis: np.ndarray, idf: np.ndarray, s: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> None:
    """Adds A'(A ``basis``) of the passages, whose rows of A have length 1 (or 0, where all terms are everywhere)."""
    passage = np.repeat(np.arange(len(sizes)), sizes)
    w = times * idf[s]
    norm = np.sqrt(np.bincount(passage, w * w, len(sizes)))[passage]
    w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0).astype(np.float32)
    own = np.zeros((len(sizes), basis.shape[1]), np.float32)
    add_rows(own, passage, basis, s, w)
    order = np.argsort(s, kind="stable")
    add_rows(total, s[order], own, passage[order], w[order])


def directions(docs: DataFrame, items: DataFrame, idf: np.ndarray, cut: DataFrame | None = None) -> np.ndarray:
    """(SLOTS, up to RANK) orthonormal right singular directions of all passages of corpus and benchmark, largest first, without those to skip."""
    rows = (passages(docs) if cut is None else cut).union(passages(items))
    count = rows.agg(F.sum(F.length("sizes"))).first()[0] or 0
    context, lanes = docs.sparkSession.sparkContext, 1024
    # each task sends SLOTS * RANK sums, so there are no more tasks than need be
    rows = rows.coalesce(max(2 * context.defaultParallelism, math.ceil(count / TASK)))
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((SLOTS, RANK)))[0].astype(np.float32)
    for _ in range(STEPS):
        shared = context.broadcast(basis)

        def part(batches, shared=shared):
            total = np.zeros((SLOTS, RANK), np.float32)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    add_image(total, shared.value, idf, *(np.frombuffer(x, kind) for x, kind in zip(row, ("<u2", np.uint8, np.uint8), strict=True)))
            for k in range(0, SLOTS, lanes):
                block = total[k : k + lanes]
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([block.tobytes()], pa.binary())], ["k", "block"])

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in group.column("block").to_pylist())
            return pa.table({"k": group.column("k")[:1], "block": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        image = np.zeros((SLOTS, RANK), np.float64)
        summed = rows.mapInArrow(part, "k long, block binary").groupBy("k").applyInArrow(add, "k long, block binary")
        for r in summed.collect():  # SLOTS * RANK numbers, whatever the size
            image[r["k"] : r["k"] + lanes] = np.frombuffer(r["block"], np.float32).reshape(-1, RANK)
        shared.unpersist()
        q, r = np.linalg.qr(image)
        basis = (q @ np.linalg.svd(r)[0]).astype(np.float32)
    return basis[:, min(SKIP, count // PER_SKIP) :]


# ---------------------------------------------------------------- items and matches


class Items:
    """Pieces of benchmark items: words, rare-word weights and latent vectors, by window scale."""

    def __init__(self, rows: list[tuple], basis: np.ndarray, idf: np.ndarray):
        self.basis, self.idf = np.vstack([basis, np.zeros((1, basis.shape[1]), basis.dtype)]), idf  # the last row fills up units
        self.ids, self.words, self.by = [], [], {s: [] for s in SCALES}
        for item, text in rows:
            w = word_list(text.encode() if text else b"")
            step = PIECE // 2
            for i in range(0, max(1, len(w) - step) if len(w) > PIECE else 1, step):
                piece = w[i : i + PIECE]
                if len(piece) >= SHORTEST:
                    self.by[max(s for s in SCALES if s == SCALES[0] or s <= 4 * len(piece) / 3)].append(len(self.ids))
                    self.ids.append(item)
                    self.words.append(piece)
        short = [(item, w) for item, text in rows if 0 < len(w := word_list(text.encode() if text else b"")) < SHORTEST]
        self.phrases = ahocorasick.Automaton()
        for phrase in {phrase_key(w) for _, w in short}:
            self.phrases.add_word(phrase, (phrase, []))
        for item, w in short:
            self.phrases.get(phrase_key(w))[1].append(len(self.ids))
            self.ids.append(item)
            self.words.append(w)
        if short:
            self.phrases.make_automaton()
        # a common subsequence of a share LIKE needs so many different words in common
        self.sets = [frozenset(p) for p in self.words]
        self.least = [math.ceil(LIKE * len(p)) - (len(p) - len(set(p))) for p in self.words]
        self.masks = [{w: sum(1 << i for i, x in enumerate(p) if x == w) for w in set(p)} for p in self.words]
        self.weights = [dict(zip(p, idf[slots(p)].tolist(), strict=True)) for p in self.words]
        latent = [basis[slots(p)].sum(0) for p in self.words]
        self.vectors = {s: unit(np.stack([latent[i] for i in at])) for s, at in self.by.items() if at}

    def match(self, tokens: list[bytes], piece: int) -> tuple[float, bool]:
        """Share of the piece in the longest common subsequence with ``tokens``, and whether that is a leak."""
        masks, n = self.masks[piece], len(self.words[piece])
        full, row = (1 << n) - 1, (1 << n) - 1
        for w in tokens:  # a bit for each word of the piece; a zero where the subsequence grows
            m = masks.get(w, 0)
            if m:
                u = row & m
                row = (row + u | row - u) & full
        share = (n - row.bit_count()) / n
        if share >= SAME or share < LIKE:
            return share, share >= SAME
        weights, there = self.weights[piece], set(tokens)
        return share, sum(v for w, v in weights.items() if w in there) >= ANSWER * sum(weights.values())


def phrase_key(tokens: list[bytes]) -> str:
    """Words between blanks, a character for each byte."""
    return b" ".join([b"", *tokens, b""]).decode("latin-1")


def phrase_matches(items: Items, tokens: list[bytes], text: int) -> list[tuple[int, int, float, float, int]]:
    """The first place of each short item in a text."""
    body, found = phrase_key(tokens), {}
    for end, (phrase, pieces) in items.phrases.iter(body):
        for piece in pieces:
            found.setdefault(piece, end - len(phrase) + 1)
    return [(text, piece, 1.0, 1.0, body.count(" ", 0, at)) for piece, at in found.items()]


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def matches(items: Items, bodies: list[bytes], first: bool = False) -> list[tuple[int, int, float, float, int]]:
    """(text, piece, cosine, share, first word) of each leak; ``first``: one for each text is enough."""
    out = []
    token_lists = [word_list(t) for t in bodies]
    at = 0
    while at < len(bodies):
        to, n = at, 0
        while to < len(bodies) and (to == at or n + len(token_lists[to]) <= CHUNK):
            n += len(token_lists[to])
            to += 1
        for lo in range(0, max(1, n), CHUNK):  # a longer text goes in overlapping parts
            lists = token_lists[at:to] if n <= CHUNK else [token_lists[at][max(0, lo - 2 * PIECE) : lo + CHUNK]]
            shift = 0 if n <= CHUNK else max(0, lo - 2 * PIECE)
            out += [(at + t, p, c, s, b + shift) for t, p, c, s, b in chunk_matches(items, lists, first)]
        at = to
    if len(items.phrases):
        for i, tokens in enumerate(token_lists):
            out += phrase_matches(items, tokens, i)
    best: dict[tuple[int, int], tuple] = {}
    for m in sorted(out, key=lambda m: (-m[3], -m[2], m[4])):
        best.setdefault((m[0], items.ids[m[1]]), m)
    return list(best.values())


def chunk_matches(items: Items, lists: list[list[bytes]], first: bool) -> list[tuple[int, int, float, float, int]]:
    lists = [x if len(x) >= SHORTEST else [] for x in lists]
    sizes = np.array([-(-len(x) // UNIT) for x in lists])
    if not sizes.sum():
        return []
    s = slots([w for x in lists for w in x])
    lengths = np.array([len(x) for x in lists])
    # units of UNIT words, the last one of a text filled up
    units = np.full(int(sizes.sum()) * UNIT, len(items.basis) - 1)
    units[np.arange(len(s)) + np.repeat(np.concatenate([[0], np.cumsum(sizes * UNIT - lengths)[:-1]]), lengths)] = s
    text_of = np.repeat(np.arange(len(lists)), sizes)
    first_unit = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    unit_no = np.arange(len(text_of)) - first_unit[text_of]
    sums = items.basis[units[::UNIT]]
    for i in range(1, UNIT):
        sums += items.basis[units[i::UNIT]]
    running = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)])
    out, done = [], set()
    for scale, vectors in items.vectors.items():
        width = scale // UNIT
        step = width // 2
        # the last window of a text may be short; a text of one window has just that
        b = np.flatnonzero((unit_no % step == 0) & ((unit_no == 0) | (unit_no + step < sizes[text_of])))
        e = np.minimum(b + width, first_unit[text_of[b]] + sizes[text_of[b]])
        cosine = unit((running[e] - running[b]).astype(np.float32)) @ vectors.T
        window, near = -1, frozenset()
        for i, k in zip(*(a.tolist() for a in np.nonzero(cosine >= NEAR)), strict=True):
            piece = items.by[scale][k]
            if i != window:  # rows come window by window
                window, text = i, int(text_of[b[i]])
                own, begin = lists[text], int(unit_no[b[i]]) * UNIT
                near = frozenset(own[max(0, begin - PIECE) : begin + scale + PIECE])
            if len(near & items.sets[piece]) < items.least[piece] or (text, piece) in done or first and text in done:
                continue
            size = len(items.words[piece])
            from_ = max(0, begin - size)
            share, leak = items.match(own[from_ : begin + scale + size], piece)
            if leak:
                done |= {(text, piece), text}
                out.append((text, piece, float(cosine[i, k]), share, from_))
    return out


def prepared(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str):
    """Blocks of benchmark pieces, with the directions of the whole corpus, one after the other."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    cut = passages(docs)
    counts, n = passage_counts(docs, cut)
    idf = np.log((n + 1) / (counts + 1)).astype(np.float32)
    basis = directions(docs, items, idf, cut) * idf[:, None]
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(chars / (BLOCK * 6 * PIECE)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(block == k).orderBy("item_id", "text").collect()]
        if rows:
            yield docs.sparkSession.sparkContext.broadcast(Items(rows, basis, idf))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, share, first_word): the best match of each text and item that leaks.

    Null and empty texts match nothing, texts of fewer than ``SHORTEST`` words only shorter items; equal
    rows match equally; an empty benchmark finds nothing.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add(benchmark.schema["item_id"]).add("cosine", "double").add("share", "double").add("first_word", "long")
    item_type, parts = to_arrow_type(benchmark.schema["item_id"].dataType), []
    for shared in prepared(docs, benchmark, doc_id, text):

        def run(batch, shared=shared):
            items = shared.value
            found = matches(items, texts(batch.column(1)))
            ids = batch.column(0).take(pa.array([m[0] for m in found], pa.int64()))
            item = pa.array([items.ids[m[1]] for m in found], item_type)
            rest = [pa.array([m[i] for m in found], kind) for i, kind in ((2, pa.float64()), (3, pa.float64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, item, *rest], schema.names)

        parts.append(arrow_map(rows, run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, their columns as they are; filtered where they lie."""
    out = docs
    for shared in prepared(docs, benchmark, doc_id, text):

        def run(column, shared=shared):
            hit = {m[0] for m in matches(shared.value, texts(column), first=True)}
            return {"_llm_clean": pa.array([i not in hit for i in range(len(column))], pa.bool_())}

        out = with_columns(out, F.col(f"`{text}`").cast("string"), run, {"_llm_clean": "boolean"}).where("_llm_clean").select(*[F.col(f"`{c}`") for c in docs.columns])
    return out


@query("op4_latent_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
