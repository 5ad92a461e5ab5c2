"""Pseudonyms that stay the same between batches: numbers of values in the state of the stream.

Values are grouped by label and bucket; the state store of a group (RocksDB, in the checkpoint) has the number of
each value and how far the group has counted. A batch touches only the values that it has, however many are known.
Group ``b`` of ``n`` gives the numbers b + 1, b + 1 + n, …, so groups never meet and a
frequent label is spread over ``n`` tasks; with one bucket the numbers of a label have no gaps.
New numbers are also written to a registry folder, from which another query can start.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import masks as M
from ..functions import spans as S
from ..operators import pii

ROWS = "label string, bucket int, file string, start int, end int, text string"
NAMED = "file string, start int, end int, label string, text string, number bigint, fresh boolean"
KNOWN = "label string, text string, number bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DOCUMENT = ""  # label of the rows that carry whole texts through
CARRIERS = 1 << 10  # groups of such rows; nothing of them is in the state, so their number is no part of the numbering


class Numbering(StatefulProcessor):
    """Numbers the values of a (label, bucket); new ones in the order in which they are first met, the last of a file first."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "text string", "number bigint")
        self.highest = handle.getValueState("highest", "number bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = self.highest.get()
        top = last[0] if last else 0
        for text, number in zip(initialState["text"], initialState["number"], strict=True):
            if isinstance(text, str):
                self.numbers.updateValue((text,), (int(number),))
            top = max(top, int(number))
        self.highest.update((top,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        label, bucket = key
        if label == DOCUMENT:
            for part in rows:
                yield part.assign(number=0, fresh=False)[["file", "start", "end", "label", "text", "number", "fresh"]]
            return
        found = pd.concat(list(rows))  # of one batch, one label and one bucket
        found = found.assign(right=-found["start"]).sort_values(["file", "right"], kind="stable")
        last = self.highest.get()
        top = last[0] if last else 0
        number, fresh = {}, set()
        for text in found["text"].drop_duplicates():
            known = self.numbers.getValue((text,))
            if known is None:
                # the next number of this bucket above all that are given
                top += 1 + (bucket - top) % self.buckets
                self.numbers.updateValue((text,), (top,))
                fresh.add(text)
                number[text] = top
            else:
                number[text] = known[0]
        if fresh:
            self.highest.update((top,))
        first = ~found["text"].duplicated()
        found = found.assign(number=found["text"].map(number).astype("int64"), fresh=first & found["text"].isin(fresh))
        yield found[["file", "start", "end", "label", "text", "number", "fresh"]]

    def close(self) -> None:
        pass


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(label, text, number) of all queries that wrote to the folder; none where it is not there."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], KNOWN)
    return spark.read.schema(KNOWN).option("recursiveFileLookup", True).parquet(path).distinct()


def run_of(spark: SparkSession, checkpoint: str, registry: str) -> str:
    """Name of the query of this checkpoint, given at its first start together with a copy of the registry as it was.

    The copy is the state that the query begins with. A restart, also one within the first batch, finds both again.
    """
    name, before = f"{checkpoint}/textspark-run", f"{checkpoint}/textspark-registry"
    given = lambda: spark.read.schema("run string").json(name).first() if folder_exists(spark, name) else None
    if given() is None:
        read_registry(spark, registry).write.mode("overwrite").parquet(before)
        spark.createDataFrame([(uuid.uuid4().hex,)], "run string").write.mode("overwrite").json(name)
    return given()["run"]


def initial_state(spark: SparkSession, checkpoint: str, buckets: int) -> DataFrame:
    """(label, bucket, text, number) of the copy, and for every bucket of a label the highest number of that label."""
    known = spark.read.schema(KNOWN).parquet(f"{checkpoint}/textspark-registry")
    bucket = F.pmod(F.xxhash64("label", "text"), F.lit(buckets)).cast("int")
    highest = known.groupBy("label").agg(F.max("number").alias("number"))
    every = highest.select("label", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("string").alias("text"), "number")
    return known.select("label", bucket.alias("bucket"), "text", "number").unionByName(every)


def value_rows(found: DataFrame, key: str, text: str, spans: str, buckets: int) -> DataFrame:
    """A row for each text and one for each of its spans."""
    cast = lambda c: c.cast("string").alias("file")
    whole = F.struct(F.lit(DOCUMENT).alias("label"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.col(text).alias("text"))
    values = F.transform(F.col(spans), lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    rows = found.select(cast(F.col(key)), F.explode(F.concat(F.array(whole), values)).alias("r")).select("file", "r.*")
    of_text, of_value = F.pmod(F.xxhash64("file"), F.lit(CARRIERS)), F.pmod(F.xxhash64("label", "text"), F.lit(buckets))
    return rows.select("label", F.when(F.col("label") == DOCUMENT, of_text).otherwise(of_value).cast("int").alias("bucket"), "file", "start", "end", "text")


def stream_numbered(
    spark: SparkSession, files: DataFrame, out: str, checkpoint: str, registry: str, entities: Sequence[str] | None = None, once: bool = False, buckets: int = 1,
    dictionary: DataFrame | None = None,
) -> StreamingQuery:
    """Streaming (file, text) with pseudonyms in place of its entities: (file, deidentified) under ``out``, new numbers under ``registry``.

    Numbers live in the checkpoint. A query with a new checkpoint begins with all numbers of the registry,
    so a value keeps its number and no number is given twice. Each query has its own folder and each batch its own in that, which a
    replay overwrites with the same rows. The number of buckets must stay the same for a checkpoint.
    """
    run = run_of(spark, checkpoint, registry)
    rows = value_rows(pii.detect(files, "text", entities, dictionary=dictionary), "file", "text", "spans", buckets)
    known = initial_state(spark, checkpoint, buckets).groupBy("label", "bucket")
    named = rows.groupBy("label", "bucket").transformWithStateInPandas(Numbering(buckets), NAMED, "append", "none", initialState=known)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the state is read and written once
        new = S.span(F.col("start"), F.col("end"), M.pseudonym(F.col("label"), F.col("number")), F.col("label"), F.lit(1.0))
        per_file = batch.where(F.col("label") != DOCUMENT).groupBy("file").agg(F.array_sort(F.collect_list(new)).alias("_new"))
        texts = batch.where(F.col("label") == DOCUMENT).select("file", "text").join(per_file, "file", "left")
        done = texts.select("file", S.replace_spans(F.col("text"), F.coalesce("_new", S.no_spans()), lambda s: s["text"]).alias("deidentified"))
        done.write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")
        batch.where("fresh").select("label", "text", "number").write.mode("overwrite").parquet(f"{registry}/run={run}/batch={batch_id}")
        batch.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
