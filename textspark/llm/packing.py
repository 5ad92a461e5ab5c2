"""Packing along a space-filling curve.

Each document's token counts are hashed to a signed vector and projected to ``DIMS`` dimensions;
the place on a Hilbert curve through them is the sort key, so documents of like words lie next
to each other. The curve is cut into ranges by bounds from a bounded sample; ties on the curve
are parted by a hash of the id, so a group of copies may span any number of ranges. A range is
sorted and cut into sequences as it streams by. What is left at its end is cut into powers of
two, which need no padding: no sequence has any.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import ROWS, arrow_map, mixed, query, table, texts

LENGTH = 2048
END = 1
DIMS = 4
GRID = 12  # bits for each dimension
SLOTS = 4096  # of the hashed vector
RANGE = 1 << 22  # ids a range is meant to hold, 8 MB; a target, not a cap
RANGES = 100_000  # from here on ranges grow with the input; they are sorted with spill and stream by
SAMPLE = 64  # sampled documents for each range
CACHE = 400_000  # parts of words whose ids a worker keeps, about 60 MB
PIECE = 1 << 20  # bytes of texts that are cut into words at once
BLANK = re.compile(rb"[ \t-\r]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # by which the usual tokenizer cuts


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(others)) for b in range(256)}


LETTER, DIGIT, OTHER, SPACE, ODD = range(5)


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of each code point of the basic plane; the last entry stands for all above.

    Odd are those by which a word takes the long way: the apostrophe, marks and all that may compose,
    what does not print, and letters without one lower-case letter of their own.
    """
    kind, low = np.full(0x10001, ODD, np.uint8), np.zeros(0x10001, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        group, down = unicodedata.category(c)[0], c.lower()
        if c in " \t\n\v\f\r":
            kind[i] = SPACE
        elif c.isprintable() and group != "M" and c not in "'Σ" and len(down) == 1 and not 0x1100 <= i < 0x1200 and unicodedata.is_normalized("NFC", c):
            kind[i], low[i] = {"L": LETTER, "N": DIGIT}.get(group, OTHER), ord(down)
    return kind, low


class Tokens:
    """Ids of texts under a public tokenizer that never joins across white space.

    Where the tokenizer is the usual kind (composed, lower case, cut by a pattern, byte letters, ends of
    words marked), the words of a batch are lowered and cut here as arrays of code points, and only
    parts not yet known go to its model. Any other word or tokenizer takes the long way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.model, self.letters = None, byte_letters()
        parts = json.loads(self.tokenizer.to_str())
        types = lambda part, name: [x["type"] for x in (part or {}).get(name, [])]
        pattern = parts.get("pre_tokenizer")
        usual = types(parts.get("normalizer"), "normalizers") == ["NFC", "Replace", "Lowercase"] and types(pattern, "pretokenizers") == ["Split", "ByteLevel"]
        if usual and pattern["pretokenizers"][0]["pattern"].get("Regex") == PATTERN and parts["model"].get("end_of_word_suffix"):
            self.kind, self.low = kinds()
            self.model = Tokenizer(self.tokenizer.model)
            self.ends = np.zeros(1 << 16, bool)
            self.ends[[i for p, i in self.tokenizer.get_vocab().items() if p.endswith(parts["model"]["end_of_word_suffix"])]] = True
        else:
            self.kind, self.low = np.full(0x10001, ODD, np.uint8), np.zeros(0x10001, np.uint32)
            self.kind[list(b" \t\n\v\f\r")] = SPACE

    def learn(self, new: list[str], odd: list[bool]) -> None:
        plain = []
        for p, long_way in zip(new, odd, strict=True):
            if long_way:
                self.known[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint16).tobytes()
            else:
                plain.append(p)
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            own = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in some]
            ids = np.array(self.model.encode_batch_fast([own], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint16)
            raw, at = ids.tobytes(), 0
            for p, end in zip(some, (2 * np.flatnonzero(self.ends[ids]) + 2).tolist(), strict=True):
                self.known[p], at = raw[at:end], end

    def parted(self, whole: str) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The parts of a text, whether each is an odd word as it is, and where each begins."""
        data = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = np.minimum(data, 0x10000)
        kind = self.kind[at]
        before = np.append(np.uint8(SPACE), kind[:-1])
        space = kind == SPACE
        begins = ~space & ((kind != before) | (kind == DIGIT))
        odd = kind == ODD
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))  # a special token may begin there
        low = self.low[at]
        if odd.any():
            word = np.cumsum(~space & (before == SPACE)) - 1
            odd = (np.bincount(word[odd], minlength=word[-1] + 1) > 0)[word] & ~space
            low, begins = np.where(odd, data, low), np.where(odd, before == SPACE, begins)
        low, first = low[~space], np.flatnonzero(begins)
        ends = np.append(0, np.cumsum(1 + (low > 0x7F).astype(np.int32) + (low > 0x7FF) + (low > 0xFFFF)))
        offsets = ends[np.append(np.flatnonzero(begins[~space]), len(low))].astype(np.int32)
        text = low.astype("<u4").tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(text)).dictionary_encode(), odd[first], first

    def ids(self, some: list[str]) -> list[np.ndarray]:
        coded, odd, first = self.parted("\n".join([*some, ""]))
        parts, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        odd_part = np.zeros(len(parts), bool)
        odd_part[at[odd]] = True
        pieces = list(map(self.known.get, parts))
        new = [i for i, x in enumerate(pieces) if x is None]
        if len(self.known) + len(new) > CACHE:
            self.known, new = {}, range(len(parts))
        self.learn([parts[i] for i in new], odd_part[new].tolist())
        for i in new:
            pieces[i] = self.known[parts[i]]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
        start, n = (np.cumsum(size) - size)[at], size[at]
        ends = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(pieces), np.uint16)[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)]
        bounds = ends[np.searchsorted(first, np.cumsum([0, *[len(t) + 1 for t in some]]))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        out, held, size = [[] for _ in bodies], [], 0

        def flush():
            for (i, _), x in zip(held, self.ids([t for _, t in held]), strict=True):
                out[i].append(x)
            held.clear()

        for i, body in enumerate(bodies):
            at = 0
            while at < len(body):  # a long text is cut at white space
                cut = BLANK.search(body, at + PIECE)
                end = cut.end() if cut else len(body)
                held.append((i, body[at:end].decode("utf-8", "replace")))
                size, at = size + end - at, end
                if size >= PIECE:
                    flush()
                    size = 0
        if held:
            flush()
        end = np.array([END], np.uint16)
        return [np.concatenate([*x, end]) for x in out]


TOKENS: dict[str, Tokens] = {}  # one for each path in a worker


def tokens(path: str) -> Tokens:
    if path not in TOKENS:
        TOKENS[path] = Tokens(path)
    return TOKENS[path]


# ---------------------------------------------------------------- the curve


def projection() -> np.ndarray:
    """What each id adds to the projected vector: the row of its slot in a seeded Gaussian matrix, with the id's sign."""
    h = mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
    rows = np.random.default_rng(11).standard_normal((SLOTS, DIMS)).astype(np.float32)
    return rows[(h % np.uint64(SLOTS)).astype(np.int64)] * np.where(h >> np.uint64(63), 1, -1).astype(np.float32)[:, None]


PROJECTION = projection()


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) with ``bits`` bits each."""
    x = cells.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns and mirrors of the cells that hold the point, largest first
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    v = np.stack([PROJECTION[x[:-1]].sum(0, dtype=np.float64) for x in ids])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return hilbert(np.clip((unit + 1) / 2 * (1 << GRID), 0, (1 << GRID) - 1).astype(np.int64), GRID)


# ---------------------------------------------------------------- sequences


def powers(n: int) -> list[int]:
    """``n`` as descending powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Range:
    """Cuts the documents of one range into sequences; holds less than one sequence of ids."""

    def __init__(self, number: int, length: int):
        self.number, self.length, self.sequence, self.held, self.room = number, length, 0, [], length

    def close(self) -> list[tuple]:
        """(row, start, ids, sequence, offset) of the pieces held."""
        out, offset = [], 0
        for row, start, ids in self.held:
            out.append((row, start, ids, (self.number << 32) + self.sequence, offset))
            offset += len(ids)
        self.held, self.room, self.sequence = [], self.length, self.sequence + 1
        return out

    def add(self, row: tuple, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        while start < len(ids):
            piece = ids[start : start + self.room]
            self.held.append((row, start, piece))
            start += len(piece)
            self.room -= len(piece)
            if not self.room:
                out += self.close()
        return out

    def end(self) -> list[tuple]:
        rest, self.held = self.held, []
        out = []
        for size in powers(sum(len(x) for _, _, x in rest)):
            room = size
            while room:
                row, start, ids = rest.pop(0)
                self.held.append((row, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (row, start + room, ids[room:]))
                room -= min(room, len(ids))
            out += self.close()
        return out


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, form: str = "<u4") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) for each piece; ids in ``form``: unsigned, little-endian, of 32 or 16 bits.

    A document is its ids and one closing id, so a null or empty text is that one id. Each id
    lies in one piece; repeated rows are packed as often as they occur; rows of equal key and tie
    are ordered by their ids. Sequences are of ``length`` ids, or at the end of a range of a power
    of two.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("tie", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    def place(batch, bounds: np.ndarray | None = None):
        ids, tie = tokens(path).encode(texts(batch.column(1))), batch.column(2).to_numpy()
        key = curve_keys(ids)
        if bounds is None:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tie), pa.array([len(x) for x in ids], pa.int64())], ["key", "tie", "size"])
        else:
            at = np.searchsorted(bounds, np.rec.fromarrays([key, tie], names="key,tie").view(bounds.dtype))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(key), batch.column(2), batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "key", "tie", "doc_id", "ids"])

    # bounds of the ranges: documents with the smallest hashes are a sample of bounded size that no partitioning changes
    chars = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 2).alias("n")).first()["n"] or 0
    ranges = min(RANGES, max(1, -(-chars // (2 * RANGE))))
    most = docs.select("tie").orderBy("tie").limit(SAMPLE * ranges).agg(F.max("tie").alias("m")).first()["m"] if ranges > 1 else None
    bounds = np.zeros(0, [("key", np.int64), ("tie", np.int64)])
    if most is not None:
        sample = arrow_map(docs.where(F.col("tie") <= most), place, "key long, tie long, size long").toPandas().sort_values(["key", "tie"])
        total = sample["size"].cumsum()
        cuts = np.unique(np.searchsorted(total, np.arange(1, ranges) * total.iloc[-1] / ranges))
        bounds = np.rec.fromarrays([sample["key"].to_numpy()[cuts], sample["tie"].to_numpy()[cuts]], names="key,tie").view(bounds.dtype)
    schema = docs.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("key"), "tie", "doc_id", F.lit(b"").alias("ids")).schema
    dealt = arrow_map(docs, lambda b: place(b, bounds), schema)
    ordered = dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key", "tie", "ids")

    def out(pieces: list[tuple], arrow) -> pa.RecordBatch:
        columns = [
            pa.array([r[0] for r, *_ in pieces], arrow), pa.array([s for _, s, *_ in pieces], pa.int64()), pa.array([len(x) for _, _, x, *_ in pieces], pa.int64()),
            pa.array([r[1] for r, *_ in pieces], pa.int64()), pa.array([q for *_, q, _ in pieces], pa.int64()), pa.array([o for *_, o in pieces], pa.int64()),
            pa.array([x.astype(form).tobytes() for _, _, x, *_ in pieces], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def cut(batches):
        now, arrow = None, None
        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            for i in range(0, batch.num_rows, ROWS):
                part, pieces = batch.slice(i, ROWS), []
                for number, doc, ids in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if now is None or now.number != number:
                        pieces += now.end() if now else []
                        now = Range(number, length)
                    x = np.frombuffer(ids, np.uint16)
                    pieces += now.add((doc, len(x)), x)
                if pieces:
                    yield out(pieces, arrow)
        if now:
            rest = now.end()
            if rest:
                yield out(rest, arrow)

    result = docs.select("doc_id").schema
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        result = result.add(name, "long")
    return ordered.mapInArrow(cut, result.add("ids", "binary"))


@query("op5_hilbert_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
