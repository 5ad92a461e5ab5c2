"""Reading documents, tables, request batches and labelled lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files under a folder; Spark raises when there is none."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def read_csv(spark: SparkSession, path: str, infer: bool = False, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Table with a header line; strings unless a schema is given or types are inferred (one more pass)."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document per trimmed line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter(F.col("text") != "")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file with its path; empty files (folder markers) are skipped."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).filter(
        F.length("text") > 0
    )


def rows_as_docs(df: DataFrame, out: str = "text") -> DataFrame:
    """All cells of a row joined by blanks make one document; blank ones are dropped."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.withColumn(out, F.trim(F.concat_ws(" ", *cells))).filter(F.col(out) != "")


def labelled(lines: DataFrame, col: str = "value") -> DataFrame:
    """``label tok tok …`` to (label, tokens)."""
    parts = F.split(F.trim(F.col(col)), r"\s+")
    return lines.filter(F.trim(F.col(col)) != "").select(
        F.get(parts, 0).cast("int").alias("label"),
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("tokens"),
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return labelled(spark.read.text(path))


def max_length(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.agg(F.max(F.size(tokens)).alias("max_length"))


RECORD = "struct<patient_id:string,text:string>"
BATCH = f"struct<data:array<{RECORD}>,body:string>"


def records_of(df: DataFrame, payload: str) -> DataFrame:
    """Records of ``{data:[{patient_id,text}]}``, bare or inside ``body`` as text or object; one row per record."""
    outer = F.from_json(F.col(payload), BATCH)
    inner = F.from_json(outer["body"], f"struct<data:array<{RECORD}>>")
    data = F.coalesce(outer["data"], inner["data"])
    kept = [c for c in df.columns if c != payload]
    return df.select(*kept, F.posexplode(data).alias("position", "_r")).select(
        *kept, "position", F.col("_r.patient_id").alias("patient_id"), F.col("_r.text").alias("text")
    )


def unread(df: DataFrame, payload: str) -> DataFrame:
    """Rows whose payload is not JSON or has no records, with the reason as ``error``: what ``records_of`` leaves out."""
    outer = F.from_json(F.col(payload), BATCH)
    inner = F.from_json(outer["body"], f"struct<data:array<{RECORD}>>")
    data = F.coalesce(outer["data"], inner["data"])
    kept = [c for c in df.columns if c != payload]
    return df.filter(F.coalesce(F.size(data), F.lit(0)) < 1).select(*kept, F.lit("no records").alias("error"))


def read_record_batch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): one request per file; a file without records is an error row with its path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return records_of(files, "value"), unread(files, "value")


def canonicalise(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Headers trimmed and renamed, every cell a string, NULL as empty string."""
    trimmed = df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(renames or {})
    return trimmed.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in trimmed.columns])


def find_column(df: DataFrame, name: str) -> str:
    """Exact name, else the first column that agrees after trimming."""
    if name in df.columns:
        return name
    for c in df.columns:
        if c.strip() == name.strip():
            return c
    raise ValueError(f"column {name!r} not found; available: {df.columns}")


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


