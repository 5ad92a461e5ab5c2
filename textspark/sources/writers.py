"""Writing results. The number of files is left to the partitioning, nothing is forced into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def write_many(tables: dict[str, DataFrame], base: str, format: str = "parquet") -> None:
    """Several named tables under one base path."""
    for name, df in tables.items():
        write(df, f"{base}/{name}", format)


def output_name(file, suffix: str = "_deidentified"):
    """Name of the output for an input file: suffix before the extension."""
    name = F.element_at(F.split(file, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.concat(stem, F.lit(suffix), ext)


def write_mirrored(df: DataFrame, path: str, file: str = "file", text: str = "text", suffix: str = "_deidentified", root: str = "") -> None:
    """One output folder per input file, keyed by its folder (below ``root``) and the suffixed name; a file's text stays in the task that has it."""
    whole = F.regexp_replace(F.col(file), "[^/]*$", "")
    below = F.when(F.startswith(whole, F.lit(root)), whole.substr(F.lit(len(root) + 1), F.length(whole))).otherwise(whole)
    named = df.select(F.trim(below, F.lit("/")).alias("folder"), output_name(F.col(file), suffix).alias("name"), F.col(text).alias("value"))
    named.write.mode("overwrite").partitionBy("folder", "name").option("lineSep", "\n").text(path)
