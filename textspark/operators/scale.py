"""Helpers that keep jobs safe at size: checked broadcasts, skew-safe joins, exact global positions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 << 20
HOT_ROWS = 100_000
SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: the table is written once to the folder the cluster names, and read again from there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return kept_in(df.sparkSession.read.schema(df.schema).parquet(path), path)


def kept_in(df: DataFrame, folder: str, table: str | None = None) -> DataFrame:
    """``df``, which knows the folder that it is read from."""
    df._kept_in = folder, table
    return df


def dropped(*tables: DataFrame) -> None:
    """Takes back the disk of tables that ``checkpointed`` or ``bucketed`` gave and nothing is to read again."""
    for df in tables:
        (folder, name), context = df.__dict__["_kept_in"], df.sparkSession.sparkContext
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Shuffle files go when the driver has collected what they belong to."""
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, count: int) -> DataFrame:
    """Like ``checkpointed``, in ``count`` buckets of ``key``: a join or a group of it with as many partitions leaves the rows where they lie."""
    spark, name = df.sparkSession, f"buckets_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    df.write.option("compression", "zstd").bucketBy(count, key).saveAsTable(name, format="parquet", path=folder)
    return kept_in(spark.table(name), folder, name)


def lane_numbers(spark: SparkSession, count: int) -> list[int]:
    """``count`` numbers, each of which a partition by hash into so many parts has for itself."""
    part = F.pmod(F.hash("id"), F.lit(count))
    return [r["n"] for r in spark.range(64 * count).groupBy(part.alias("p")).agg(F.min("id").alias("n")).orderBy("p").collect()]


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the table has at most ``rows`` rows and ``BROADCAST_BYTES`` bytes; reads no more than one row beyond.

    The size is that of the values as text, so long phrases and arrays count for what they are.
    """
    width = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in df.columns), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= BROADCAST_BYTES


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after a check of the size; otherwise Spark picks the join."""
    return F.broadcast(df) if fits(df, rows) else df


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread: Column | None = None,
    how: str = "left",
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table with a dictionary that has one row per key.

    A dictionary of checked size is broadcast. A larger one is joined by shuffle;
    frequent keys are then spread over ``SALTS`` tasks by ``spread`` (a column that
    varies within a key) against that many copies of the dictionary.
    """
    if fits(dim, rows):
        return fact.join(F.broadcast(dim), list(keys), how)
    if spread is None:
        return fact.join(dim, list(keys), how)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # the copies are larger than Spark thinks: it would broadcast them
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def counted_lookup(fact: DataFrame, dim: DataFrame, keys: Sequence[str], count: str, spread: Column, hot: int = HOT_ROWS) -> DataFrame:
    """Join with a dictionary that knows how often each key occurs in ``fact``.

    At most (rows of fact) / ``hot`` keys can be hot; those are broadcast after a
    size check, so their rows never meet in one task. All other keys have fewer
    than ``hot`` rows and are joined by shuffle. The dictionary, an aggregate much
    smaller than ``fact``, is written once so that checking its size costs no second run.
    """
    dim = checkpointed(dim)
    if fits(dim):
        return fact.join(F.broadcast(dim), list(keys), "left")
    payload = [c for c in dim.columns if c not in keys]
    frequent = dim.filter(F.col(count) >= hot).select(*keys, F.struct(*payload).alias("_hot"))
    staged = fact.join(sized_broadcast(frequent), list(keys), "left")
    # rows already served get a salt that matches nothing, so they spread evenly; the key goes once, in the struct
    kind = lambda k: "string" if fact.schema[k].dataType != dim.schema[k].dataType else fact.schema[k].dataType
    key = lambda salt: F.struct(*[F.col(k).cast(kind(k)).alias(k) for k in keys], salt.alias("_s"))
    salt = F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int"))
    whole = [k for k in keys if fact.schema[k].dataType == dim.schema[k].dataType]
    staged = staged.withColumn("_key", key(salt)).drop(*whole)
    rest = dim.filter(F.col(count) < hot).select(key(F.lit(-1)).alias("_key"), F.struct(*payload).alias("_cold"))
    joined = staged.join(rest, "_key", "left")
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*[F.col("_key")[c].alias(c) if c in whole else F.col(c) for c in fact.columns], *[both[p].alias(p) for p in payload])


def global_position(df: DataFrame, by: Sequence[Column], name: str = "position") -> DataFrame:
    """Exact 1-based position of every row in a total order, without a single-task sort.

    Rows are range-partitioned and sorted; the position is the row's place in its
    partition plus the sizes of the partitions before it. The sorted rows are
    checkpointed first, so a lost executor cannot change the ranges in between.
    """
    if df.schema.fieldNames() and name in df.columns:
        raise ValueError(f"column {name} exists")
    ordered = checkpointed(df.orderBy(*by).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition: thousands at most
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_part", "_before", "_mid")
    )


def grouped_position(df: DataFrame, group: Sequence[str], by: Sequence[Column], name: str = "position") -> DataFrame:
    """Exact 1-based position within each group; a group may span any number of tasks."""
    ranked = global_position(df, [*[F.col(g) for g in group], *by], "_global")
    bounds = ranked.groupBy(*group).agg(F.min("_global").alias("_group_start"), F.count("*").alias("_group_rows"))
    joined = counted_lookup(ranked, bounds, group, "_group_rows", F.col("_global"))
    return joined.withColumn(name, F.col("_global") - F.col("_group_start") + 1).drop("_global", "_group_start", "_group_rows")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Best k rows per group; Spark cuts every group to k rows per task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, as (by…, prob, quantile), without holding a group in one task."""
    keyed = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if not by:
        keyed = keyed.withColumn("_all", F.lit(1))
    group = list(by) or ["_all"]
    ranked = global_position(keyed, [*[F.col(g) for g in group], F.col("_v")], "_pos")
    spans = ranked.groupBy(*group).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    wanted = spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "_h", F.col("prob") * (F.col("_n") - 1)
    )
    wanted = wanted.withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h"))
    picks = wanted.select(
        *group, "prob", "_h", "_lo", F.explode(F.array_distinct(F.array("_lo", "_hi"))).alias("_k"), "_first"
    ).withColumn("_pos", F.col("_first") + F.col("_k"))
    hit = picks.join(ranked.select("_pos", "_v"), "_pos")
    low = F.max(F.when(F.col("_k") == F.col("_lo"), F.col("_v")))
    high = F.max(F.when(F.col("_k") != F.col("_lo"), F.col("_v")))
    out = hit.groupBy(*group, "prob").agg(low.alias("_a"), high.alias("_b"), F.first("_h").alias("_h"), F.first("_lo").alias("_l"))
    quantile = F.col("_a") + F.coalesce((F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_l")), F.lit(0.0))
    return out.select(*by, "prob", quantile.alias("quantile"))
