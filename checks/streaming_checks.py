"""Streaming jobs: documents and records written as arriving files, run until all files are read, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textspark.operators.scale import shared_folder
from textspark.streaming import jobs, numbering

from .base import RE2_DETECTORS, documents, query, sql_replace, table
from .pii_checks import sql_detectors
from .sentiment_checks import LABEL_SQL, LEX, lexicon, polarity_sql

col = F.col
ALL = list(RE2_DETECTORS)


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def arrived(df, folder: str) -> str:
    """A file for each id of (id, text) with its texts, a line end behind each; files arrive in bundles."""
    lines = df.where(F.length("text") > 0).groupBy("id").agg(F.array_sort(F.collect_list("text")).alias("t"))
    name = F.concat(F.lit("id="), F.coalesce(F.col("id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    lines.select(name.alias("file"), F.concat(F.array_join("t", "\n"), F.lit("\n")).alias("text")).write.json(f"{folder}/in")
    return f"{folder}/in"


def of_file(name: str = "file"):
    return F.regexp_extract(name, "id=([0-9]+)", 1).cast("bigint")


def document_files(spark, sf, folder: str) -> str:
    return arrived(documents(spark, sf).select(col("doc_id").alias("id"), "text"), folder)


FILES = "files AS (SELECT doc_id, text || chr(10) AS text FROM documents WHERE length(text) > 0)"


@query(
    "st1_stream_redact_files",
    f"WITH {FILES}, {sql_detectors('files', 'doc_id', ALL)}, n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id), r AS ({sql_replace('files', 'doc_id', 'spans', chr(39) + '[' + chr(39) + ' || label || ' + chr(39) + ']' + chr(39), 'redacted')}) "
    "SELECT doc_id, redacted, CAST(coalesce(n, 0) AS BIGINT) AS entity_count FROM r LEFT JOIN n USING (doc_id)",
)
def _(spark, sf):
    folder = new_folder(spark)
    jobs.stream_redact(spark, document_files(spark, sf, folder), f"{folder}/out", f"{folder}/c", once=True, bundles=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(of_file().alias("doc_id"), "redacted", col("entity_count").cast("bigint").alias("entity_count"))


@query(
    "st2_stream_offsets_files",
    f"WITH {FILES}, {sql_detectors('files', 'doc_id', ALL)} SELECT doc_id, s AS start, e AS stop, txt AS text, label, count(*) OVER (PARTITION BY doc_id) AS entity_count FROM spans",
)
def _(spark, sf):
    folder = new_folder(spark)
    jobs.stream_offsets(spark, document_files(spark, sf, folder), f"{folder}/out", f"{folder}/c", once=True, bundles=True).awaitTermination()
    schema = "file string, entity_count bigint, text_preview string, entities array<struct<start: bigint, end: bigint, text: string, label: string, confidence: double>>"
    rows = spark.read.schema(schema).json(f"{folder}/out").select(of_file().alias("doc_id"), "entity_count", F.explode("entities").alias("x"))
    return rows.select("doc_id", col("x.start").alias("start"), col("x.end").alias("stop"), col("x.text").alias("text"), col("x.label").alias("label"), "entity_count")


@query("st3_stream_sentiment_files", f"WITH {FILES}, {LEX}, {polarity_sql('files', 'doc_id')} SELECT doc_id, {LABEL_SQL} AS label, compound, pos, neg, neu FROM pol")
def _(spark, sf):
    folder = new_folder(spark)
    jobs.stream_sentiment(spark, document_files(spark, sf, folder), f"{folder}/out", f"{folder}/c", lexicon(spark, sf), once=True, bundles=True).awaitTermination()
    scored = spark.read.schema("file string, label string, compound double, pos double, neg double, neu double").json(f"{folder}/out")
    return scored.select(of_file().alias("doc_id"), "label", "compound", "pos", "neg", "neu")


def request_files(spark, sf, folder: str) -> str:
    """A conversation a file: its turns as records, some without an id or a text; every seventh file is no JSON."""
    record = F.struct("turn", F.when(col("turn") % 3 != 2, col("role")).alias("patient_id"), F.when(col("turn") % 4 != 3, col("text")).otherwise("  ").alias("text"))
    whole = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(record)).alias("r"))
    payload = F.to_json(F.struct(F.transform("r", lambda r: F.struct(r["patient_id"].alias("patient_id"), r["text"].alias("text"))).alias("data")))
    return arrived(whole.select(col("conv_id").alias("id"), F.when(col("conv_id") % 7 == 6, "{data: [").otherwise(payload).alias("text")), folder)


REQUESTS = (
    "rec AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, CASE WHEN turn % 3 <> 2 THEN role END AS patient_id, CASE WHEN turn % 4 <> 3 THEN text ELSE '  ' END AS text FROM conversations WHERE conv_id % 7 <> 6), "
    "good AS (SELECT conv_id * 1000000 + position AS k, conv_id, position, patient_id, text FROM rec WHERE patient_id IS NOT NULL AND trim(coalesce(text, '')) <> '')"
)


@query(
    "st4_stream_record_batches",
    f"WITH {REQUESTS}, {LEX}, {polarity_sql('good', 'k')}, {sql_detectors('good', 'k', ['EMAIL_ADDRESS', 'US_SSN'])}, r AS ({sql_replace('good', 'k', 'spans', chr(39) + '[' + chr(39) + ' || label || ' + chr(39) + ']' + chr(39), 'redacted')}) "
    f"SELECT conv_id, CAST(position AS BIGINT) AS position, redacted, {LABEL_SQL} AS label, CAST(NULL AS VARCHAR) AS error FROM good JOIN r USING (k) JOIN pol USING (k) "
    "UNION ALL SELECT conv_id, CAST(position AS BIGINT), NULL, NULL, CASE WHEN patient_id IS NULL THEN 'record without id' ELSE 'empty text' END FROM rec WHERE patient_id IS NULL OR trim(coalesce(text, '')) = '' "
    "UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), NULL, NULL, 'no records' FROM conversations WHERE conv_id % 7 = 6",
)
def _(spark, sf):
    folder = new_folder(spark)
    jobs.stream_records(spark, request_files(spark, sf, folder), f"{folder}/out", f"{folder}/c", lexicon(spark, sf), ["EMAIL_ADDRESS", "US_SSN"], once=True, bundles=True).awaitTermination()
    good = spark.read.schema("record string, redacted_text string, label string").json(f"{folder}/out/results").withColumn("error", F.lit(None).cast("string"))
    bad = spark.read.schema("record string, error string").json(f"{folder}/out/errors").select("record", F.lit(None).cast("string").alias("redacted_text"), F.lit(None).cast("string").alias("label"), "error")
    position = F.coalesce(F.try_element_at(F.split("record", "#"), F.lit(2)).cast("bigint"), F.lit(-1))
    return good.select("record", "redacted_text", "label", "error").unionByName(bad).select(of_file("record").alias("conv_id"), position.alias("position"), col("redacted_text").alias("redacted"), "label", "error")


@query(
    "st5_line_corpus_job",
    f"WITH lines AS (SELECT row_number() OVER () AS k, trim(line) AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE length(text) > 0) WHERE trim(line) <> ''), {sql_detectors('lines', 'k', ALL)}, "
    f"r AS ({sql_replace('lines', 'k', 'spans', chr(39) + '[' + chr(39) + ' || label || ' + chr(39) + ']' + chr(39), 'redacted')}) SELECT 'COMPLETED' AS status, redacted, count(*) AS n FROM r GROUP BY redacted",
)
def _(spark, sf):
    folder = new_folder(spark)
    documents(spark, sf).where(F.length("text") > 0).select("text").write.text(f"{folder}/in")
    status = jobs.run_corpus_job(spark, f"{folder}/in", f"{folder}/out", f"{folder}/c", "job")
    return spark.read.parquet(f"{folder}/out/texts").groupBy("redacted").agg(F.count("*").alias("n")).withColumn("status", F.lit(status))


def document_stream(spark, sf, folder: str):
    """(file, text) of all documents as a stream."""
    rows = documents(spark, sf).select(col("doc_id").cast("string").alias("file"), "text")
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


NUMBERED = (
    f"{sql_detectors('documents', 'doc_id', ALL)}, seen AS (SELECT label, txt, min((CAST(doc_id AS VARCHAR), -s)) AS first FROM spans GROUP BY label, txt), "
    "num AS (SELECT label, txt, row_number() OVER (PARTITION BY label ORDER BY first) AS number FROM seen), "
    "named AS (SELECT x.doc_id, x.s, x.e, x.txt, x.label || '_' || number AS label FROM spans x JOIN num USING (label, txt))"
)


@query("st6_stateful_pseudonyms", f"WITH {NUMBERED} " + sql_replace("documents", "doc_id", "named", "'[' || label || ']'", "deidentified"))
def _(spark, sf):
    """All documents as one stream; numbers from the state store."""
    folder = new_folder(spark)
    rows = document_stream(spark, sf, folder)
    numbering.stream_numbered(spark, rows, f"{folder}/out", f"{folder}/c", f"{folder}/registry", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(col("file").cast("bigint").alias("doc_id"), "deidentified")


@query("st6_registry", f"WITH {NUMBERED} SELECT label, txt AS text, number FROM num")
def _(spark, sf):
    """The registry of a second stream over the same documents, which begins with that of a first one and gives no new number."""
    folder = new_folder(spark)
    for run in ("first", "second"):
        numbering.stream_numbered(spark, document_stream(spark, sf, f"{folder}/{run}"), f"{folder}/{run}", f"{folder}/c-{run}", f"{folder}/registry", once=True).awaitTermination()
    return numbering.read_registry(spark, f"{folder}/registry")
