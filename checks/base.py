"""Registry of queries, table access and the derived notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.functions.expr import string_array
from textspark.resources import values as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents")


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer files than cores, as in tests, is spread over the cores before CPU-heavy text work.

    A large input has splits enough and is left as it is: its text is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


# ---------------------------------------------------------------- notes: one per order, same text in Spark and SQL


def notes(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    people = table(spark, sf, "customer").join(
        F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    first = F.element_at(string_array(V.FAKE_FIRST), (k % 10 + 1).cast("int"))
    last = F.element_at(string_array(V.FAKE_LAST), (F.floor(k / 10) % 10 + 1).cast("int"))
    other = F.element_at(string_array(V.FAKE_LAST), (o % 10 + 1).cast("int"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = F.concat(
        F.lit("Patient "), first, F.lit(" "), last,
        F.lit(", SSN "), pad(k % 900 + 100, 3), F.lit("-45-"), pad(o % 10000, 4),
        F.lit(", aged "), (o % 80 + 20).cast("string"), F.lit(" years, was admitted on "),
        F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" at "), (o % 12 + 1).cast("string"), F.lit(":"), pad(o % 60, 2),
        F.lit(" PM. Chart opened "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(o % 3 == 0, " by Dr. ").otherwise(" by "), first, F.lit(" "), other,
        F.when(o % 5 == 0, ", MD").otherwise(""), F.lit(" of "), F.col("n_name"),
        F.lit(". Call (416) 555-"), pad(o % 10000, 4),
        F.lit(" or write "), F.lower(first), F.lit("."), o.cast("string"), F.lit("@mail.example.com, file MRN-"), pad(k, 8), F.lit("."),
    )
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        o.alias("note_id"), k.alias("patient_id"), text.alias("text")
    )


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


NOTES = f"""notes AS (
  SELECT o_orderkey AS note_id, o_custkey AS patient_id,
    'Patient ' || ({_list(V.FAKE_FIRST)})[o_custkey % 10 + 1] || ' ' || ({_list(V.FAKE_LAST)})[(o_custkey // 10) % 10 + 1]
    || ', SSN ' || lpad(CAST(o_custkey % 900 + 100 AS VARCHAR), 3, '0') || '-45-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
    || ', aged ' || CAST(o_orderkey % 80 + 20 AS VARCHAR) || ' years, was admitted on '
    || strftime(o_orderdate, '%m/%d/%Y') || ' at ' || CAST(o_orderkey % 12 + 1 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0')
    || ' PM. Chart opened ' || strftime(o_orderdate, '%Y-%m-%d')
    || CASE WHEN o_orderkey % 3 = 0 THEN ' by Dr. ' ELSE ' by ' END
    || ({_list(V.FAKE_FIRST)})[o_custkey % 10 + 1] || ' ' || ({_list(V.FAKE_LAST)})[o_orderkey % 10 + 1]
    || CASE WHEN o_orderkey % 5 = 0 THEN ', MD' ELSE '' END || ' of ' || n_name
    || '. Call (416) 555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
    || ' or write ' || lower(({_list(V.FAKE_FIRST)})[o_custkey % 10 + 1]) || '.' || CAST(o_orderkey AS VARCHAR) || '@mail.example.com, file MRN-'
    || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '.' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# ---------------------------------------------------------------- SQL pieces

RE2_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("DATE", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\s+\d{4}\b"),
    ("TIME", r"\b\d{1,2}:\d{2}(?:\s?[AP]M)?\b"),
    ("POSTAL_CODE", r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"),
    ("PHONE", r"(?:\+?1[-. ])?(?:\(?\d{3}\)?[-. ])\d{3}[-. ]\d{4}\b"),
    ("ID", r"\b[A-Z]{1,4}-[A-Z0-9]{2,}-?[0-9]{0,4}\b"),
]
RE2_DETECTORS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "URL": r"(?:https?://|www\.)[^\s<>\"]+",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "CREDIT_CARD": r"\b\d(?:[ -]?\d){12,18}\b",
    "IP_ADDRESS": r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b",
    "DATE_TIME": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{1,2}:\d{2}(?:\s?[AP]M)?)\b",
    "PHONE_NUMBER": r"(?:\+?\d{1,2}[-. ])?(?:\(\d{3}\)|\b\d{3})[-. ]\d{3}[-. ]\d{4}\b",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_matches(source: str, key: str, label: str, pattern: str, rank: int = 0, text: str = "text") -> str:
    """SELECT of (key, s, e, txt, label, rank): matches with offsets from the lengths of gaps and matches."""
    return f"""SELECT {key}, CAST(pos0 AS BIGINT) AS s, CAST(pos0 + length(txt) AS BIGINT) AS e, txt, {lit(label)} AS label, {rank} AS rank FROM (
      SELECT {key}, ms[i] AS txt,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS pos0
      FROM (SELECT {key}, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT {key}, regexp_extract_all({text}, {lit(pattern)}) AS ms, string_split_regex({text}, {lit(pattern)}) AS gaps FROM {source})))"""


def sql_structured(source: str, key: str, name: str = "spans") -> str:
    """CTE of structured spans: a later match inside an earlier pattern's span is dropped."""
    parts = "\n UNION ALL ".join(sql_matches(source, key, l, p, i) for i, (l, p) in enumerate(RE2_PATTERNS))
    return f"""{name}_all AS ({parts}),
{name} AS (SELECT * FROM {name}_all a WHERE NOT EXISTS (
  SELECT 1 FROM {name}_all b WHERE b.{key} = a.{key} AND b.rank < a.rank AND b.s <= a.s AND a.e <= b.e))"""


def sql_replace(source: str, key: str, spans: str, replacement: str, out: str = "out", extra: str = "") -> str:
    """SELECT of (key, out): text with each span of the CTE replaced by the SQL expression over (txt, label, s, e)."""
    return f"""SELECT d.{key}{extra}, CASE WHEN p.{key} IS NULL THEN d.text ELSE p.body || substr(d.text, CAST(p.last_e + 1 AS BIGINT)) END AS {out}
FROM {source} d LEFT JOIN (
  SELECT {key}, string_agg(piece, '' ORDER BY s) AS body, max(e) AS last_e FROM (
    SELECT x.{key}, x.s, x.e,
      substr(t.text, CAST(coalesce(lag(x.e) OVER (PARTITION BY x.{key} ORDER BY x.s), 0) + 1 AS BIGINT),
             CAST(x.s - coalesce(lag(x.e) OVER (PARTITION BY x.{key} ORDER BY x.s), 0) AS BIGINT)) || ({replacement}) AS piece
    FROM {spans} x JOIN {source} t ON t.{key} = x.{key}) GROUP BY {key}) p ON p.{key} = d.{key}"""
