"""Sources, sinks and guards: tables written to the shared folder, read back, and compared with the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textspark.operators import filters, pii
from textspark.operators.scale import shared_folder
from textspark.sources import readers, writers

from .base import documents, query, spread, table

CUSTOMER = "c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment"


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/io-{name}-{uuid.uuid4().hex}"


def customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_nationkey", "round(c_acctbal, 2) AS c_acctbal", "c_mktsegment")


def back(spark, sf, format: str):
    path = folder(spark, format)
    writers.write(customers(spark, sf), path, format)
    return path


def typed(df):
    return df.selectExpr("bigint(c_custkey) AS c_custkey", "c_name", "bigint(c_nationkey) AS c_nationkey", "double(c_acctbal) AS c_acctbal", "c_mktsegment")


TYPED = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(round(c_acctbal, 2) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer"


@query("io2_read_csv_header", TYPED)
def _(spark, sf):
    return typed(readers.read_csv(spark, back(spark, sf, "csv"), infer=True))


@query("io3_read_tsv", TYPED)
def _(spark, sf):
    path = folder(spark, "tsv")
    customers(spark, sf).write.option("header", True).option("sep", "\t").csv(path)
    return typed(readers.read_csv(spark, path, sep="\t", infer=True))


@query(
    "io4_read_lines",
    "SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' GROUP BY 1",
)
def _(spark, sf):
    path = folder(spark, "lines")
    documents(spark, sf).select("text").write.text(path)
    return readers.read_lines(spark, path).groupBy(F.md5("text").alias("line_md5")).agg(F.count("*").alias("n"))


@query(
    "io5_read_whole_files",
    "SELECT CAST(c_nationkey AS BIGINT) AS nation, md5(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS text_md5, CAST(sum(length(c_name) + 1) AS BIGINT) AS n_chars FROM customer GROUP BY 1",
)
def _(spark, sf):
    path = folder(spark, "files")
    one_task = customers(spark, sf).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    one_task.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).cast("bigint").alias("nation")
    return readers.read_files(spark, path).select(nation, F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


@query("io10_find_column", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    df = customers(spark, sf).withColumnRenamed("c_mktsegment", " c_mktsegment ")
    return df.groupBy(F.col(f"`{readers.find_column(df, 'c_mktsegment')}`").alias("segment")).agg(F.count("*").alias("n"))


@query("io11_require_columns", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name FROM customer")
def _(spark, sf):
    return readers.require(customers(spark, sf), ["c_custkey", "c_name"]).selectExpr("bigint(c_custkey) AS c_custkey", "c_name")


@query("io12_write_parquet", TYPED)
def _(spark, sf):
    return typed(readers.read_docs(spark, back(spark, sf, "parquet")))


@query("io13_write_csv", TYPED)
def _(spark, sf):
    return typed(readers.read_csv(spark, back(spark, sf, "csv")))


@query("io14_write_json_stats", TYPED)
def _(spark, sf):
    return typed(spark.read.json(back(spark, sf, "json")))


@query(
    "io15_write_mirrored_files",
    "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder, 'n' || c_nationkey || '_deidentified.txt' AS name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL",
)
def _(spark, sf):
    path = folder(spark, "mirrored")
    side = F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b")
    named = customers(spark, sf).withColumn("file", F.concat(F.lit("s3://in/"), side, F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit(".txt")))
    writers.write_mirrored(named, path, text="c_mktsegment", root="s3://in")
    return spark.read.text(path).groupBy("folder", "name", "value").agg(F.count("*").alias("n"))


@query("io16_write_many", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def _(spark, sf):
    path = folder(spark, "many")
    names = ("customer", "orders")
    writers.write_many({n: table(spark, sf, n) for n in names}, path)
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return counts[0].unionByName(counts[1])


@query("pf4_corpus_size_guard", "SELECT count(*) AS n FROM documents")
def _(spark, sf):
    return filters.guard_corpus(documents(spark, sf), 5).agg(F.count("*").alias("n"))


KINDS = ["SSN", "EMAIL"]


@query("pf10_reject_unknown_types", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'SSN' ELSE 'EMAIL' END AS label FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    known = pii.validate_types([k.lower() for k in KINDS])
    third = F.when(F.col("c_custkey") % 3 == 0, "PHONE")
    label = F.coalesce(third, F.when(F.col("c_custkey") % 2 == 0, "SSN").otherwise("EMAIL"))
    return customers(spark, sf).select("c_custkey", label.alias("label")).filter(F.col("label").isin(known))


@query("so4_sample_limit", "SELECT least(count(*), 3000) AS n FROM lineitem")
def _(spark, sf):
    return filters.sample_rows(spread(table(spark, sf, "lineitem"))).agg(F.count("*").alias("n"))
