"""Fake values from pools of any size: a pool is a table, its values are numbered, and a keyed hash picks a number.

Nothing of a pool is in the plan. Each distinct (label, text) is joined once with the number that its hash picks;
a pool of checked size is broadcast for that, a larger one is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S
from ..resources import values as V
from . import pii
from .scale import checkpointed, counted_lookup, grouped_position, sized_broadcast


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(label, value) of ``value#LABEL`` lines."""
    lines = spark.read.text(path).where(F.col("value").contains("#"))
    return lines.select(F.substring_index("value", "#", -1).alias("label"), F.substring_index("value", "#", 1).alias("value"))


def built_in_pool(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(label, v) for label, values in V.POOLS.items() for v in values], "label string, value string")


def pool_table(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((label, number, value), (label, size)): distinct values numbered from 0 in their order, and one row a label."""
    rows = pool.select("label", "value").where(F.col("label").isNotNull() & F.col("value").isNotNull()).distinct()
    numbered = checkpointed(grouped_position(rows, ["label"], [F.asc("value")], "_n").select("label", (F.col("_n") - 1).alias("number"), "value"))
    return numbered, checkpointed(numbered.groupBy("label").agg(F.count("*").alias("size")))


def pick(basis: Column, seed: int | str, size: Column) -> Column:
    """0-based number below ``size`` that depends on (basis, seed) only; for sizes below 2³² the one of in-plan lists."""
    digest = F.md5(F.concat(basis, F.lit(f"|{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.when(size > (1 << 32) - 1, F.conv(F.substring(digest, 9, 7), 16, 10).cast("bigint") * (1 << 32)).otherwise(F.lit(0)), size)


def picked_values(pairs: DataFrame, pool: DataFrame, seed: int | str = 42) -> DataFrame:
    """(label, text, …, value) of distinct (label, text) rows; a label without a pool gives null."""
    numbered, sizes = pool_table(pool)
    asked = pairs.join(sized_broadcast(sizes), "label", "left").withColumn("number", pick(F.col("text"), seed, F.col("size")))
    # hashes spread the distinct pairs evenly over the numbers, so a join by shuffle has no frequent key
    return asked.join(sized_broadcast(numbered), ["label", "number"], "left").drop("size", "number")


def obfuscate_from(df: DataFrame, key: str, text: str, spans: str, pool: DataFrame, seed: int | str = 42, out: str = "obfuscated") -> DataFrame:
    """``df`` with every span replaced by a value of its label's pool, the same one for equal texts; labels without a pool in brackets.

    ``key`` is unique in ``df``. Texts without spans take no part in the joins.
    """
    whole = checkpointed(df.withColumn("_some", F.coalesce(F.size(spans) > 0, F.lit(False))))
    found = checkpointed(pii.explode_spans(whole.where("_some"), spans, [key]))
    pairs = found.groupBy("label", "text").agg(F.count("*").alias("_times"))
    values = picked_values(pairs, pool, seed).withColumnRenamed("value", "_value")
    named = counted_lookup(found, values, ["label", "text"], "_times", F.struct(key, "start"))
    new = S.span(F.col("start"), F.col("end"), F.coalesce("_value", F.concat(F.lit("["), F.col("label"), F.lit("]"))), F.col("label"), F.lit(1.0))
    replacements = named.groupBy(key).agg(F.array_sort(F.collect_list(new)).alias("_new"))
    changed = whole.where("_some").join(replacements, key, "left")
    changed = changed.withColumn(out, S.replace_spans(F.col(text), F.coalesce("_new", S.no_spans()), lambda s: s["text"])).drop("_new", "_some")
    return changed.unionByName(whole.where(~F.col("_some")).withColumn(out, F.col(text)).drop("_some"))


def columns_from_pool(df: DataFrame, columns: dict[str, str], pool: DataFrame, seeds: dict[str, int] | None = None) -> DataFrame:
    """Named columns replaced by values of the pool of their type, the same one for equal values; null stays null.

    Each distinct value is looked up once. A type without a pool is an error.
    """
    sizes = pool.where(F.col("label").isin(*set(columns.values()))).select("label").distinct()
    missing = set(columns.values()) - {r["label"] for r in sizes.collect()}  # one row a type asked for
    if missing:
        raise ValueError(f"no pool for types {sorted(missing)}")
    out = df
    for column, kind in columns.items():
        text = F.col(f"`{column}`").cast("string")
        pairs = out.where(text.isNotNull()).groupBy(text.alias("text")).agg(F.count("*").alias("_times")).withColumn("label", F.lit(kind))
        values = picked_values(pairs, pool, (seeds or {}).get(column, 42)).select("text", "_times", F.col("value").alias("_value"))
        rows = out.withColumn("text_of_column", text)
        joined = counted_lookup(rows, values.withColumnRenamed("text", "text_of_column"), ["text_of_column"], "_times", F.monotonically_increasing_id())
        out = joined.withColumn(column, F.col("_value")).select(*[F.col(f"`{c}`") for c in df.columns])
    return out

