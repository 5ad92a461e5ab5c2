"""Web archives: WARC records with revisits, and a capture index merged from sorted runs.

Records are text in UTF-8, so Spark writes and reads the archives itself, in any store: a record ends
with two line ends, and the next one's first line starts it. A payload that holds such a
boundary is written in base64. Each task's captures are sorted where they are and written as
a run; runs are cut into blocks at bounds from a bounded sample, and each range of keys merges
its blocks by a loser tree. Only blocks that overlap are held.
"""

from __future__ import annotations

import bisect
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import arrow_map, new_folder, query, table, written

END = "\r\n\r\n"
START = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100  # bytes of a payload that others revisit
EPOCH = 1_700_000_000  # seconds; pages have no time of their own: their id counts on from here
BLOCK = 4096  # captures
RANGE = 250_000  # captures a range is meant to hold; a target, not a cap
SAMPLE = 200  # sampled keys for each range
ADMIT = 1024  # blocks that join the merge at once


# ---------------------------------------------------------------- records


def recorded(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, captured) with payload, its size and digest, record_type and refers_to.

    Of payloads of at least ``LEAST`` bytes that are equal, the smallest page_id is the response,
    nulls last; rows that repeat it are responses too, and so are all of them where no id is known.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumn("payload", payload).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256)).drop("html")
    large = rows.where(F.col("payload_bytes") >= LEAST)
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    joined = rows.join(groups, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def header(name: str, value: Column) -> Column:
    """A header line; nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record() -> Column:
    """The WARC record of a row, without the line ends behind it."""
    revisit = F.col("record_type") == "revisit"
    unsafe = F.contains(F.col("payload"), F.lit(END + "WARC/"))
    body = F.when(revisit, "").when(unsafe, F.regexp_replace(F.base64(F.encode("payload", "UTF-8")), r"\s", "")).otherwise(F.col("payload"))
    odd = F.col("url").rlike(r"[\x00-\x1F\x7F]")
    block = F.concat(F.lit(HTTP), body)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return F.concat(
        F.lit(START),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", urn("page_id")),
        header("WARC-Target-URI", F.when(~odd, F.col("url"))),
        header("X-Target-URI-Base64", F.when(odd, F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))),
        header("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        header("WARC-Refers-To", urn("refers_to")),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("X-Block-Encoding", F.when(unsafe & ~revisit, F.lit("base64"))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_archives(rows: DataFrame, path: str) -> None:
    """One archive a task, compressed."""
    rows.select(record().alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, page_id: str = "long") -> DataFrame:
    """(page_id, url, captured, record_type, payload_digest, payload_bytes, refers_to, payload) of each record.

    A response whose payload is not what its headers say is an error.
    """
    raw = spark.read.option("lineSep", END + START).text(path)
    # the first record of a file has its first line left, the last one its line ends; the length says where a block stops
    text = F.regexp_replace("value", "^WARC/1[.]1\r\n", "")
    head = F.concat(F.substring_index(text, END, 1), F.lit("\r\n"))
    field = lambda name: F.nullif(F.regexp_extract(F.col("head"), f"(?:^|\n){name}: ([^\r]*)\r", 1), F.lit(""))
    rows = raw.select(text.alias("text"), head.alias("head"))
    rows = rows.select(
        F.regexp_extract("head", "(?:^|\n)WARC-Record-ID: <urn:page:([^>]*)>", 1).try_cast(page_id).alias("page_id"),
        F.coalesce(field("WARC-Target-URI"), F.decode(F.unbase64(field("X-Target-URI-Base64")), "UTF-8")).alias("url"),
        F.to_timestamp(field("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        field("WARC-Type").alias("record_type"),
        F.substring(field("WARC-Payload-Digest"), 8, 64).alias("payload_digest"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_extract("head", "(?:^|\n)WARC-Refers-To: <urn:page:([^>]*)>", 1).try_cast(page_id).alias("refers_to"),
        field("X-Block-Encoding").alias("encoding"),
        F.expr("substring(encode(text, 'UTF-8'), octet_length(head) + 3, int(regexp_extract(head, 'Content-Length: ([0-9]+)', 1)))").alias("block"),
    )
    body = F.expr(f"substring(block, {len(HTTP) + 1})")
    rows = rows.withColumn("payload", F.when(F.col("encoding") == "base64", F.unbase64(F.decode(body, "UTF-8"))).otherwise(body)).drop("block", "encoding")
    sound = (F.col("record_type") == "revisit") | ((F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    whole = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of "), F.coalesce("url", F.lit("no url")))))
    return rows.withColumn("payload_digest", whole)


# ---------------------------------------------------------------- the index


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then the rest, in lower case: pages of one domain lie together."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"(?s)^[^:/?#]*://", "")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest.substr(F.length(host) + 1, F.length(rest) + 1))


class LoserTree:
    """Merges sorted sources: each inner node keeps the loser of its match, the winner goes on; a new head replays one path."""

    def __init__(self, sources: list[Iterator]):
        self.sources, self.k = sources, max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.nodes = [-1] * self.k  # at 0 the winner
        for i in range(self.k):
            self.replay(i, building=True)

    def less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and (x[0], a) < (y[0], b)

    def replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            if building and self.nodes[node] < 0:
                self.nodes[node] = i  # waits for its opponent
                return
            if self.less(self.nodes[node], i):
                self.nodes[node], i = i, self.nodes[node]
            node //= 2
        self.nodes[0] = i

    def peek(self):
        return self.heads[self.nodes[0]]

    def pop(self):
        i = self.nodes[0]
        head, self.heads[i] = self.heads[i], next(self.sources[i], None)
        self.replay(i)
        return head


INDEX = ["url_key", "captured", "page_id"]


def keys_of(batch: pa.RecordBatch) -> list[tuple]:
    """Sort keys of rows, nulls first as Spark has them."""
    times = batch.column("captured").cast(pa.int64()).to_pylist()
    return [(u, t if t is not None else -(1 << 62), i is not None, i if i is not None else 0) for u, t, i in zip(batch.column("url_key").to_pylist(), times, batch.column("page_id").to_pylist(), strict=True)]


def packed(rows: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_batch(rows)
    return out.getvalue()


def unpacked(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def merged_index(captures: DataFrame) -> DataFrame:
    """``captures`` (with url_key, captured, page_id) and (part, place): ordered by these two, all are in order of url_key, captured, page_id."""
    runs = written(captures.sortWithinPartitions(*INDEX), "runs")
    schema = runs.schema
    parts = max(1, -(-runs.count() // RANGE))
    picked = runs.select(*INDEX).orderBy(F.xxhash64(*INDEX)).limit(SAMPLE * parts).toArrow().to_batches() if parts > 1 else []
    sample = sorted(k for b in picked for k in keys_of(b))
    bounds = sorted({sample[i * len(sample) // parts] for i in range(1, parts)}) if sample else []

    def cut(batch):
        keys = keys_of(batch)
        part = [bisect.bisect_right(bounds, k) for k in keys]
        starts = [0] + [i for i in range(1, len(keys)) if part[i] != part[i - 1] or keys[i] < keys[i - 1]] + [len(keys)]
        out = [(i, min(i + BLOCK, b)) for a, b in zip(starts, starts[1:], strict=False) for i in range(a, b, BLOCK)]
        at = pa.array([a for a, _ in out])
        columns = [pa.array([part[a] for a, _ in out], pa.int32()), *[batch.column(c).take(at) for c in INDEX], pa.array([packed(batch.slice(a, b - a)) for a, b in out], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", *INDEX, "block"])

    blocks = arrow_map(runs, cut, runs.select(F.lit(0).alias("part"), *INDEX, F.lit(b"").alias("block")).schema, rows=None)
    ordered = blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("part", *INDEX)

    def merge(batches):
        def rows():
            for batch in batches:
                firsts = keys_of(batch)
                yield from zip(batch.column("part").to_pylist(), firsts, batch.column("block").to_pylist(), strict=True)

        def source(block: bytes):
            data = unpacked(block)
            yield from ((k, data, i) for i, k in enumerate(keys_of(data)))

        def flush(part: int, place: int, held: list) -> pa.RecordBatch:
            by: dict[int, list[int]] = {}
            for n, (_, data, _i) in enumerate(held):
                by.setdefault(id(data), []).append(n)
            tables, order = [], []
            for at in by.values():
                tables.append(held[at[0]][1].take(pa.array([held[n][2] for n in at])))
                order += at
            places = pa.array([place + n for n in order], pa.int64())
            whole = pa.Table.from_batches(tables).combine_chunks().append_column("part", pa.array([part] * len(order), pa.int32())).append_column("place", places)
            return whole.sort_by("place").combine_chunks().to_batches()[0]

        stream = rows()
        waiting, part, place, alive = next(stream, None), None, 0, []
        while waiting or alive:
            if not alive:
                place = 0 if waiting[0] != part else place
                part = waiting[0]
            # one at least: its first key is not above the limit, so the merge goes on however many runs overlap
            room = max(1 + len(alive) // 16, ADMIT - len(alive))
            while waiting and waiting[0] == part and room:
                alive.append(source(waiting[2]))
                waiting, room = next(stream, None), room - 1
            limit = waiting[1] if waiting and waiting[0] == part else None
            tree, held = LoserTree(alive), []
            while (head := tree.peek()) is not None and (limit is None or head[0] <= limit):
                held.append(tree.pop())
                if len(held) == BLOCK:
                    yield flush(part, place, held)
                    place, held = place + len(held), []
            if held:
                yield flush(part, place, held)
                place += len(held)
            alive = [again(h, s) for h, s in zip(tree.heads, tree.sources, strict=False) if h is not None]

    return ordered.mapInArrow(merge, schema.add("part", "integer").add("place", "long"))


def again(head, rest: Iterator) -> Iterator:
    yield head
    yield from rest


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, path: str | None = None) -> DataFrame:
    """Writes the archives of ``pages`` to ``path`` (by default a new folder of the shared one), reads them back, and gives their merged index.

    Columns: page_id, url, captured, record_type, payload_digest, payload_bytes, refers_to,
    url_key, part, place. Null payloads are empty ones, null urls have the key of an empty one;
    equal rows are kept, in any order among themselves.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "archives")
    when = captured if captured is not None else F.timestamp_seconds(EPOCH + F.coalesce(F.col(f"`{page_id}`").cast("long"), F.lit(0)))
    plain = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"), when.alias("captured"))
    write_archives(recorded(plain), path)
    kind = plain.schema["page_id"].dataType.simpleString()
    return merged_index(read_archives(spark, path, kind).drop("payload").withColumn("url_key", url_key(F.col("url"))))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND low IS NOT NULL AND page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM m
"""


@query("op3_warc_index", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
