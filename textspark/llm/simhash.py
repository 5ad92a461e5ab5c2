"""SimHash near-duplicates: fingerprints in vantage-point trees over the Hamming distance.

A tree fitted on a bounded sample of fingerprints deals all of them out to shards. At each
node a fingerprint goes to the inner side where its distance to the vantage point is within
the radius, and to the outer side beyond. By the triangle inequality two fingerprints within
``reach`` bits can only be parted where the inner one lies within ``reach`` of the boundary;
those go to both sides. So each linked pair meets in a shard, whole and exactly.
Inside a shard the same split goes on in memory down to small cells. A shard gives a spanning
forest of its links, not all pairs, so a group of copies costs as much as it has members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import arrow_map, hashes, mixed, query, spans, table, texts, with_columns, words, written
from textspark.llm.components import components

SHARD = 20_000  # fingerprints a shard is meant to hold; a target, not a cap
CELL = 512
SAMPLE = 64  # sampled fingerprints for each shard, to fit the trees
ROWS = 255


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values (n, lanes) have each bit, lowest first."""
    total = np.zeros(h.shape[1] * 64, np.int64)
    for i in range(0, len(h), ROWS):
        block = np.ascontiguousarray(h[i : i + ROWS]).view(np.uint8)
        total += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.uint8)  # at most 255 rows: no overflow
    return total


def majority(h: np.ndarray) -> np.ndarray:
    """Bits set in over half of the values (n, lanes); zero without values."""
    return np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    h = hashes(spans(words(text.lower()), width))
    return int(majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (64 bits as a signed long). Null and wordless texts have fingerprint 0."""

    def run(column):
        return {"fingerprint": pa.array(np.array([fingerprint(t, width) for t in texts(column)], np.uint64).view(np.int64))}

    return with_columns(docs, F.col(text), run, {"fingerprint": "long"})


# ---------------------------------------------------------------- trees


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, radius and distances that part ``points`` with the fewest on both sides; None if nothing parts them."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = distance(points, v)
        mu = int(np.median(d))
        larger = max(int((d <= mu).sum()), int((d > mu - reach).sum()))
        if best is None or larger < best[0]:
            best = larger, v, mu, d
    return best[1:] if best and best[0] < 0.9 * len(points) else None


def fit(sample: np.ndarray, depth: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full binary tree, node n's children at 2n+1 and 2n+2; radius -1: all go outside."""
    at, mu = np.zeros(2**depth - 1, sample.dtype), np.full(2**depth - 1, -1, np.int64)
    rng, here = np.random.default_rng(7), {0: sample}
    for n in range(len(at)):
        points = here.pop(n, sample[:0])
        part = split(points, reach, rng) if len(points) > 1 else None
        if part:
            at[n], mu[n], d = part
            here[2 * n + 1], here[2 * n + 2] = points[d <= mu[n]], points[d > mu[n] - reach]
        else:
            here[2 * n + 2] = points
    return at, mu


def route(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of a point and number of a shard, for each shard that it has to be in."""
    at, mu = tree
    who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(depth):
        d, m = distance(points[who], at[node]).astype(np.int64), mu[node]
        inner, outer = d <= m, (m < 0) | (d > m - reach)
        who, node = np.concatenate([who[inner], who[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
    return who, node - (2**depth - 1)


def near_pairs(f: np.ndarray, reach: int, of_cell) -> np.ndarray:
    """What ``of_cell`` gives, as rows (i, j), for the cells of a shard that hold all pairs within ``reach``."""
    out, rng, cells = [], np.random.default_rng(3), [np.arange(len(f))]
    while cells:
        cell = cells.pop()
        part = split(f[cell], reach, rng) if len(cell) > CELL else None
        if part:
            _, mu, d = part
            cells += [cell[d <= mu], cell[d > mu - reach]]
        elif len(cell) > 1:
            out.append(of_cell(cell))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def all_links(cell: np.ndarray, f: np.ndarray, reach: int) -> np.ndarray | None:
    """Every pair within ``reach``; None for a cell that is large or has many links for each point."""
    if len(cell) > 2 * CELL:
        return None
    i, j = np.nonzero(np.triu(distance(f[cell][:, None], f[cell][None, :]) <= reach, 1))
    return np.stack([cell[i], cell[j]], 1) if len(i) <= 4 * len(cell) else None


def forest(cell: np.ndarray, f: np.ndarray, reach: int) -> np.ndarray:
    """A spanning forest of the links of a cell: each point is reached once, and what is reached is searched no more."""
    few = all_links(cell, f, reach)
    if few is not None:
        return few
    rest, found = cell, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            near = distance(f[rest], f[p]) <= reach
            found.append(np.stack([np.full(int(near.sum()), p), rest[near]], 1))
            queue += rest[near].tolist()
            rest = rest[~near]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def depth_for(n: int, shard: int = SHARD) -> int:
    return max(0, math.ceil(math.log2(max(1, n / shard))))


def sample_of(df: DataFrame, column: str, depth: int) -> list:
    """The ``SAMPLE`` values for each shard with the smallest hash: a bounded sample that does not depend on partitions."""
    picked = df.select(column).orderBy(F.xxhash64(column), column).limit(SAMPLE * 2**depth)
    return [r[0] for r in picked.collect()]


# ---------------------------------------------------------------- exact components within a few bits


def linked(prints: DataFrame, reach: int = 2) -> DataFrame:
    """(fingerprint, root) of the distinct longs in ``prints``: those reachable by steps of at most ``reach`` bits share a root."""
    distinct = written(prints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct(), "prints")
    depth = depth_for(distinct.count())
    tree = fit(np.array(sample_of(distinct, "fingerprint", depth), np.int64).view(np.uint64), depth, reach)

    def deal(batch):
        f = batch.column(0).to_numpy()
        who, shard = route(f.view(np.uint64), tree, depth, reach)
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(f[who])], ["shard", "fingerprint"])

    def search(part: pa.Table) -> pa.Table:
        f = part.column("fingerprint").to_numpy()
        g = f.view(np.uint64)
        pairs = near_pairs(g, reach, lambda cell: forest(cell, g, reach))
        return pa.table({"a": f[pairs[:, 0]], "b": f[pairs[:, 1]]})

    dealt = arrow_map(distinct, deal, "shard long, fingerprint long")
    roots = components(dealt.groupBy("shard").applyInArrow(search, "a long, b long"))
    roots = roots.select(F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    return distinct.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest id that links reach.

    Null ids are never smallest (a component of null ids only has a null one); repeated rows
    are equal and so linked; null, empty and wordless texts have fingerprint 0, linked like any other.
    """
    own = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width).select("doc_id", "fingerprint"), "fingerprints")
    per_print = own.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).join(linked(own, reach), "fingerprint")
    lowest = per_print.groupBy("root").agg(F.min("low").alias("component_id"))
    named = per_print.join(lowest, "root").select("fingerprint", "component_id")
    return own.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_simhash_components")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- copies by similarity of five-word shingles

LANES = 16  # 1,024 bits: 32 tables of 32 bits
TABLES = 2 * LANES
REACH = 2
CHECK = 6  # lanes that travel with a table's 32 bits
TABLE_SHARD = 1 << 18  # records of 72 bytes, about 20 MB a task
LEADERS = 64  # of a cell with many links: most leaders, and points by which one is chosen
NEAREST = 4  # partners of each point in the first pass over what leaders leave unlinked
WIDER = 8  # times as many partners in each further pass


def sketch(h: np.ndarray) -> np.ndarray:
    """``LANES`` words of SimHash bits of a set of shingle hashes."""
    total, n = np.zeros(LANES * 64, np.int64), len(h)
    lanes = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, n, 1 << 14):
        total += bit_counts(mixed(h[i : i + (1 << 14), None] + lanes))
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)


def share_for(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(hashes(spans(words(text.lower()), width)))


def sketches(column: pa.Array, width: int) -> dict[str, pa.Array]:
    return {"value": pa.array([sketch(shingle_set(t, width)).tobytes() for t in texts(column)], pa.binary())}


def word_keys(column: pa.Array) -> dict[str, pa.Array]:
    """128 bits of the sequence of words: equal for exact copies."""
    return {"_llm_key": pa.array([xxhash.xxh3_128_digest(b" ".join(words(t.lower()))) for t in texts(column)], pa.binary())}


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``x`` and each of ``y``."""
    return sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.int16) for k in range(x.shape[1]))


def candidates(cell: np.ndarray, f: np.ndarray, check: np.ndarray, reach: int, most: float, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Pairs of a cell to be compared first, of which at most ``most`` check bits differ, and whether these are all of them.

    All pairs within ``reach`` where they are few; else each point with one leader: of the more
    central half of the points the first in ``order`` leads all within ``most`` bits, then one of
    the rest, and so on. With one order for all tables most tables choose the same leaders. ``crossing`` gives the rest, once it is known which of them are linked.
    """
    pairs = all_links(cell, f, reach)
    if pairs is not None:
        return pairs[np.bitwise_count(check[pairs[:, 0]] ^ check[pairs[:, 1]]).sum(1, dtype=np.int64) <= most], True
    rest, found = cell, [np.zeros((0, 2), np.int64)]
    for _ in range(LEADERS):
        if len(rest) < 2:
            break
        mean = apart(check[rest], check[rest[:: max(1, len(rest) // LEADERS)]]).sum(1, dtype=np.int64)
        central = rest[mean <= np.median(mean)]
        leader = central[order[central].argmin()]
        rest = rest[rest != leader]
        led = apart(check[rest], check[leader][None])[:, 0] <= most
        found.append(np.stack([rest[led], np.full(int(led.sum()), leader)], 1))
        rest = rest[~led]
    return np.concatenate(found), False


def crossing(root: np.ndarray, check: np.ndarray, most: float, room: int, number: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a cell with different roots, of which at most ``most`` check bits differ, and the points with more of them.

    Each point gets its ``room`` nearest such partners. The members of the largest root are only
    partners: every pair of different roots has an end outside it. ``number`` is that of the table
    whose cell this is, if ``check`` has all bits: a pair is left to the first table that has it.
    """
    parts = check.view(np.uint32)
    _, own, n = np.unique(root, return_inverse=True, return_counts=True)
    ends = np.flatnonzero(own != n.argmax())
    found, more = [np.zeros((0, 2), np.int64)], [ends[:0]]
    for i in range(0, len(ends), CELL):
        at = ends[i : i + CELL]
        d = apart(check[at], check)
        ok = (d <= most) & (own[at][:, None] != own[None, :])
        if number is not None:
            ok &= np.bitwise_count(parts[at, None, number] ^ parts[None, :, number]) <= REACH
            x, y = np.nonzero(ok)
            for j in range(0, len(x), 1 << 16):
                u, v = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
                ok[u, v] = ~(np.bitwise_count(parts[at[u], :number] ^ parts[v, :number]) <= REACH).any(1)
        over = ok.sum(1) > room
        x, y = np.nonzero(ok & ~over[:, None])
        found.append(np.stack([at[x], y], 1))
        if over.any():
            near = np.argpartition(np.where(ok[over], d[over], 32_000), room, axis=1)[:, :room]
            found.append(np.stack([np.repeat(at[over], room), near.ravel()], 1))
            more.append(at[over])
    return np.concatenate(found), np.concatenate(more)


def verified(links: DataFrame, sides: DataFrame, keep) -> DataFrame:
    """The links (a, b) for which ``keep`` holds of what ``sides`` (key, value: binary) has of both."""
    side = lambda c: sides.select(F.col("key").alias(c), F.col("value").alias(f"{c}_value"))
    both = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_value", "b_value")

    def run(batch):
        ok = [keep(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(both, run, "a binary, b binary")


def share_of_sets(x: bytes, y: bytes) -> float:
    """Jaccard similarity of two sets of 64-bit values; two empty sets are equal."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar_classes(docs: DataFrame, keyed: DataFrame, ids: DataFrame, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    """(key, root) of every distinct word sequence that is linked to another one; keys of one root are near copies.

    Each text has 1,024 SimHash bits of its set of shingles, cut into 32 tables of 32 bits. Two
    texts are compared where they are within 2 bits in some table (a pair of similarity 0.8
    misses all 32 with a probability of 2 %, one of 0.85 with 0.1 %), found by one
    vantage-point tree for each table; then by 384 bits, by all bits, and at last exactly by
    their sets of shingles. Only the texts of pairs are moved for that.

    In cells with many links each text is first compared with one leader. What this leaves unlinked is
    compared across the groups found, with ever more partners for each text, until each pair of
    the cell is either compared or within one group.
    """
    share = share_for(similarity)
    most = lambda lanes, sigmas: (share + sigmas * math.sqrt(share * (1 - share) / (64 * lanes))) * 64 * lanes
    rough, finer = most(CHECK, 3), most(LANES, 2.5)
    made = with_columns(docs.select(F.col(text).alias("text")), F.col("text"), lambda c: word_keys(c) | sketches(c, width), {"_llm_key": "binary", "value": "binary"})
    known = written(made.groupBy(F.col("_llm_key").alias("key")).agg(F.min("value").alias("value")), "sketches")
    depth = depth_for(known.count(), TABLE_SHARD)
    sample = np.frombuffer(b"".join(sample_of(known, "value", depth)), np.uint32).reshape(-1, TABLES)
    trees = [fit(np.ascontiguousarray(sample[:, t]), depth, REACH) for t in range(TABLES)]
    size = 8 * CHECK

    def deal(batch):
        keys, full = batch.column(0), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TABLES)
        for t in range(TABLES):
            who, shard = route(np.ascontiguousarray(full[:, t]), trees[t], depth, REACH)
            check = np.take(full[who], np.arange(t + 1, t + 1 + 2 * CHECK), axis=1, mode="wrap").tobytes()
            checks = pa.array([check[i : i + size] for i in range(0, len(check), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard + (t << depth)), keys.take(pa.array(who)), pa.array(full[who, t].view(np.int32)), checks], ["shard", "key", "bits", "check"])

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        check = np.frombuffer(b"".join(part.column("check").to_pylist()), np.uint64).reshape(-1, CHECK)
        f = part.column("bits").to_numpy().view(np.uint32)
        order = np.frombuffer(b"".join(k[:8] for k in part.column("key").to_pylist()), np.uint64)
        dense = []

        def of_cell(cell):
            pairs, whole = candidates(cell, f, check, REACH, rough, order)
            if not whole:
                dense.append(cell)
            return pairs

        pairs = near_pairs(f, REACH, of_cell)
        members = np.concatenate([pairs[:0, 0], *dense])
        numbers = np.repeat(np.arange(len(dense)), [len(c) for c in dense]) + (part.column("shard")[0].as_py() << 32)
        key, none = part.column("key"), len(pairs)
        return pa.table({
            "cell": pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(numbers, pa.int64())]),
            "a": key.take(pa.array(np.concatenate([pairs[:, 0], members]))),
            "b": pa.concat_arrays([key.take(pa.array(pairs[:, 1])).combine_chunks(), pa.nulls(len(members), pa.binary())]),
        })

    tried: list[DataFrame] = []

    def exact(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are as similar as asked, without pairs of an earlier call."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for earlier in tried:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates")
        tried.append(pairs)
        links = written(verified(pairs, known, lambda x, y: (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= finer), "near")
        ends = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
        chosen = ids.join(ends, "key").groupBy("key").agg(F.min(F.struct("id")).alias("first")).select("key", "first.id")
        same = F.col("_llm_id").eqNullSafe(F.col("id")) & (F.col("_llm_key") == F.col("key"))
        moved = keyed.select(F.col(doc_id).alias("_llm_id"), F.col(text).alias("text"), "_llm_key").join(chosen, same).select("key", "text")
        sets = with_columns(moved, F.col("text"), lambda c: {"value": pa.array([shingle_set(t, width).tobytes() for t in texts(c)], pa.binary())}, {"value": "binary"})
        sets = written(sets.select("key", "value").dropDuplicates(["key"]), "sets")
        return written(verified(links, sets, lambda x, y: share_of_sets(x, y) >= similarity), "links")

    dealt = arrow_map(known, deal, "shard long, key binary, bits int, check binary")
    found = written(dealt.groupBy("shard").applyInArrow(search, "cell long, a binary, b binary"), "found")
    links = exact(found.where(F.col("cell").isNull()))
    roots = components(links).select(F.col("node").alias("key"), F.col("component").alias("root"))
    dense = found.where(F.col("cell").isNotNull()).select("cell", F.col("a").alias("key"))
    room, open_ = NEAREST, not dense.isEmpty()

    def across(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        key, (_, root) = part.column("key"), np.unique(np.array(part.column("root").to_pylist(), object), return_inverse=True)
        pairs, more = crossing(root, np.frombuffer(b"".join(part.column("value").to_pylist()), np.uint64).reshape(-1, LANES), finer, room, part.column("cell")[0].as_py() >> 32 + depth)
        b = pa.concat_arrays([key.take(pa.array(pairs[:, 1])).combine_chunks(), pa.nulls(len(more), pa.binary())])
        return pa.table({"a": key.take(pa.array(np.concatenate([pairs[:, 0], more]))), "b": b})

    while open_:
        placed = known.join(roots, "key", "left").select("key", "value", F.coalesce("root", "key").alias("root"))
        marked = dense.join(placed, "key")
        # cells within one group have nothing left
        parted = marked.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("cell")
        left = written(marked.join(parted, "cell", "left_semi").groupBy("cell").applyInArrow(across, "a binary, b binary"), "crossing")
        new = exact(left.where(F.col("b").isNotNull()))
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(links).select(F.col("node").alias("key"), F.col("component").alias("root"))
        open_ = not left.where(F.col("b").isNull()).isEmpty()
        room *= WIDER
    return roots


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each group of exact or near copies: that with the smallest id, nulls last.

    Texts without words are copies of each other. Of rows with equal id and words one stays.
    Columns stay as they are.
    """
    keyed = with_columns(docs, F.col(text), word_keys, {"_llm_key": "binary"})
    ids = written(keyed.select(F.col(doc_id).alias("id"), F.col("_llm_key").alias("key")).distinct(), "keys")
    roots = similar_classes(docs, keyed, ids, doc_id, text, width, similarity)
    classed = ids.join(roots, "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"))
    kept = classed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("best"))
    kept = kept.select(F.col("best.id").alias("_llm_id"), F.col("best.key").alias("_llm_best"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_best"))
    return keyed.join(kept, same, "left_semi").dropDuplicates([doc_id, "_llm_key"]).drop("_llm_key")
