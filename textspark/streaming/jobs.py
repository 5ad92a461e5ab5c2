"""Jobs on arriving files with Structured Streaming.

Every sink is safe to replay: file sinks track their batches themselves, and
``foreachBatch`` writers overwrite the folder of their own batch id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import masks as M
from ..functions import spans as S
from ..functions import text as T
from ..operators import pii, sentiment
from ..operators.scale import counted_lookup, grouped_position, sized_broadcast
from ..sources.readers import records_of, unread
from .numbering import folder_exists, stream_numbered

REGISTRY = "label string, text string, number bigint, batch bigint"


def stream_files(spark: SparkSession, path: str, limit: int | None = None, max_files: int = 1000, bundles: bool = False) -> DataFrame:
    """(file, text) per arriving file; empty files (folder markers) are skipped.

    Whole texts by default; ``limit`` keeps the first characters only, where a caller needs the old service limit.
    Very many small files are better sent in ``bundles``: arriving files with a JSON line {"file": …, "text": …} for each of them.
    """
    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
    if bundles:
        raw = reader.format("json").schema("file string, text string").load(path)
    else:
        raw = reader.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    text = F.col("text") if limit is None else T.truncate(F.col("text"), limit)
    return raw.select("file", text.alias("text")).filter(F.length("text") > 0)


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_redact(
    spark: SparkSession, source: str, out: str, checkpoint: str, entities: Sequence[str] | None = None, limit: int | None = None, once: bool = False, bundles: bool = False
) -> StreamingQuery:
    """(file, redacted, entity_count) per file, appended to ``out``."""
    found = pii.detect(stream_files(spark, source, limit, bundles=bundles), "text", entities)
    redacted = found.select(
        "file", S.replace_spans(F.col("text"), F.col("spans"), M.label_text).alias("redacted"), F.size("spans").alias("entity_count")
    )
    return _start(redacted.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, once)


def stream_offsets(
    spark: SparkSession, source: str, out: str, checkpoint: str, entities: Sequence[str] | None = None, limit: int | None = None, once: bool = False, bundles: bool = False
) -> StreamingQuery:
    """Entities with offsets per file as JSON."""
    found = pii.detect(stream_files(spark, source, limit, bundles=bundles), "text", entities)
    rows = found.select("file", F.size("spans").alias("entity_count"), T.preview(F.col("text")).alias("text_preview"), F.col("spans").alias("entities"))
    return _start(rows.writeStream.format("json").outputMode("append").option("path", out), checkpoint, once)


def stream_sentiment(
    spark: SparkSession, source: str, out: str, checkpoint: str, lexicon: DataFrame, limit: int | None = None, once: bool = False, bundles: bool = False
) -> StreamingQuery:
    """Sentiment label and scores per file as JSON, one folder per batch."""

    def score(batch: DataFrame, batch_id: int) -> None:
        scored = sentiment.labelled_polarity(batch, "file", "text", lexicon)
        scored.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return _start(stream_files(spark, source, limit, bundles=bundles).writeStream.foreachBatch(score), checkpoint, once)


def stream_records(
    spark: SparkSession, source: str, out: str, checkpoint: str, lexicon: DataFrame, entities: Sequence[str] | None = None, once: bool = False, bundles: bool = False
) -> StreamingQuery:
    """Request batches: results under ``out/results``, bad records under ``out/errors``."""
    from ..plans.jobs import analyse_records

    def run(batch: DataFrame, batch_id: int) -> None:
        requests = batch.withColumnRenamed("text", "payload").persist()  # results, errors and unread ones come from it
        records = records_of(requests, "payload").withColumn("record", F.concat_ws("#", "file", F.col("position").cast("string")))
        results, errors = analyse_records(records, "record", "patient_id", "text", lexicon, entities)
        empty = unread(requests, "payload").select(F.col("file").alias("record"), F.lit(None).cast("string").alias("patient_id"), "error")
        results.write.mode("overwrite").json(f"{out}/results/batch={batch_id}")
        errors.unionByName(empty).write.mode("overwrite").json(f"{out}/errors/batch={batch_id}")
        requests.unpersist()

    return _start(stream_files(spark, source, bundles=bundles).writeStream.foreachBatch(run), checkpoint, once)


def run_corpus_job(
    spark: SparkSession, source: str, out: str, checkpoint: str, job_id: str, entities: Sequence[str] | None = None
) -> str:
    """All new one-document-per-line files redacted to ``out/texts``; a job row with its status goes to ``out/jobs``."""
    lines = spark.readStream.format("text").load(source)
    docs = lines.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("text")).filter(F.col("text") != "")
    found = pii.detect(docs, "text", entities)
    redacted = found.select("file", S.replace_spans(F.col("text"), F.col("spans"), M.label_text).alias("redacted"))
    query = _start(redacted.writeStream.format("parquet").outputMode("append").option("path", f"{out}/texts"), checkpoint, True)
    status = "COMPLETED"
    try:
        query.awaitTermination()
    except Exception as error:
        status = f"FAILED: {str(error)[:200]}"
    row = spark.createDataFrame([(job_id, status)], "job_id string, status string").withColumn("finished", F.current_timestamp())
    row.write.mode("append").json(f"{out}/jobs")
    return status


# ---------------------------------------------------------------- pseudonyms that survive between batches


def registry_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Registry rows of earlier batches only, so that a replayed batch sees what it saw before.

    The first batch has none, and its folder need not be there; rows of later batches in it are then those of
    another query, an error. Later on a registry that cannot be
    read is an error: numbering anew would give two people one pseudonym.
    """
    if batch_id == 0:
        if folder_exists(spark, path) and not spark.read.schema(REGISTRY).parquet(path).filter(F.col("batch") > 0).isEmpty():
            raise ValueError(f"{path} has batches of another query: go on with its checkpoint, or use stream_consistent, which begins with its numbers")
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(path).filter(F.col("batch") < batch_id)


def extend_registry(spark: SparkSession, spans: DataFrame, order: str, path: str, batch_id: int) -> DataFrame:
    """Numbers the (label, text) pairs not seen before, behind the highest number of their label.

    ``spans`` has label, text, start and the order column. Only the new pairs are
    sorted, over ranges, and written to the folder of this batch.
    """
    known = registry_before(spark, path, batch_id)
    seen = spans.groupBy("label", "text").agg(F.min(F.struct(F.col(order), (-F.col("start")).alias("_right"))).alias("_seen"), F.count("*").alias("n"))
    fresh = seen.join(known.select("label", "text"), ["label", "text"], "left_anti")
    numbered = grouped_position(fresh, ["label"], [F.col("_seen")], "_k")
    highest = known.groupBy("label").agg(F.max("number").alias("_last"))  # one row per label
    new = numbered.join(sized_broadcast(highest), "label", "left").select(
        "label", "text", (F.coalesce("_last", F.lit(0)) + F.col("_k")).cast("bigint").alias("number")
    )
    new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return seen.select("label", "text", "n").join(registry_before(spark, path, batch_id + 1).select("label", "text", "number"), ["label", "text"])


def pseudonymise_batch(batch: DataFrame, batch_id: int, key: str, text: str, registry: str, entities: Sequence[str] | None = None) -> DataFrame:
    """(key, deidentified) with the pseudonyms of the registry, which is extended first."""
    spark = batch.sparkSession
    found = pii.detect(batch, text, entities)
    spans = pii.explode_spans(found, "spans", [key])
    table = extend_registry(spark, spans, key, registry, batch_id)
    named = counted_lookup(spans, table, ["label", "text"], "n", F.struct(key, "start"))
    new = S.span(F.col("start"), F.col("end"), M.pseudonym(F.col("label"), F.col("number")), F.col("label"), F.lit(1.0))
    per_doc = named.groupBy(key).agg(F.array_sort(F.collect_list(new)).alias("_new"))
    joined = batch.join(per_doc, key, "left")
    return joined.select(key, S.replace_spans(F.col(text), F.coalesce("_new", S.no_spans()), lambda s: s["text"]).alias("deidentified"))


def stream_consistent(
    spark: SparkSession, source: str, out: str, checkpoint: str, registry: str, entities: Sequence[str] | None = None, once: bool = False, buckets: int = 1
) -> StreamingQuery:
    """Arriving files with pseudonyms that stay the same between batches, and between queries on one registry folder.

    Numbers are in the state store of the stream; ``buckets`` spreads frequent labels over so many tasks.
    """
    return stream_numbered(spark, stream_files(spark, source), out, checkpoint, registry, entities, once, buckets)
