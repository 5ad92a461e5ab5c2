"""What the operators share: tables in the shared folder, Arrow batches, words, folds."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, computed once, outlives any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS = 256  # rows whose Python values a task holds at once
pa.set_memory_pool(pa.system_memory_pool())  # workers live long and are to give memory back


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType | str, rows: int | None = ROWS) -> DataFrame:
    """``fn`` over Arrow batches of at most ``rows`` rows (None: as they come); a narrow step, without shuffle."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield from fn(batch.slice(i, rows))

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, source: Column, fn: Callable[[pa.Array], dict[str, pa.Array]], names: dict[str, str]) -> DataFrame:
    """All columns of ``df``, each as it is, and those that ``fn`` makes of ``source``; ``names`` has their types.

    A column of ``df`` with one of these names (in any case) is replaced.
    """
    taken = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in taken]
    given = df.select(*[F.col(f"`{c}`") for c in kept], source.alias("_llm_source"))
    schema = given.drop("_llm_source").schema
    for name, kind in names.items():
        schema = schema.add(name, DataType.fromDDL(kind))

    def run(batch):
        made = fn(batch.column(len(kept)))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[made[n] for n in names]], [*kept, *names])

    return arrow_map(given, run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Runs of bytes other than the six of ASCII white space (space, tab to carriage return)."""
    return text.split()


def spans(tokens: list[bytes], width: int) -> list[bytes]:
    """Each run of ``width`` words joined by a space; the whole sequence where it is shorter, nothing of nothing."""
    if len(tokens) <= width:
        return [b" ".join(tokens)] if tokens else []
    ends = np.cumsum([len(w) + 1 for w in tokens])
    joined = b" ".join(tokens)
    starts = [0, *ends[:-width].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def hashes(parts: list[bytes], seed: int = 42) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(p, seed) for p in parts), np.uint64, len(parts))


def mixed(x: np.ndarray) -> np.ndarray:
    """A second hash of 64-bit values, by shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def crc(values: np.ndarray) -> int:
    return zlib.crc32(values.tobytes())


def no_rows(batch_schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for _, t in batch_schema], [n for n, _ in batch_schema])
