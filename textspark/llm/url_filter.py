"""URL filters: rules of host and path, and gradient-boosted trees for what no rule decides.

Trees see the shape of a URL: length, depth, digits, entropy, parameters, and how often
labelled URLs of the same host suffix were blocked. All features are Column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import query, table, written
from textspark.operators import scale

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PRIOR = 20.0  # rows that a suffix is drawn to the mean with
SAMPLE = 20_000  # labelled URLs the trees are fitted on
TREES, DEPTH, STEP = 10, 4, 0.3
FEATURES = ["length", "host_length", "depth", "digits", "entropy", "parameters", "query_length", "labels", "hyphens", "fragment", "short_suffix", "long_suffix"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and one without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits a host or its parent and the beginning of a path; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # the longest is tried first; equal ones in the order given
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def count_of(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def entropy(text: Column) -> Column:
    """Of the characters, in nats; 0 for an empty text."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log(share(c)))


def with_shape(pages: DataFrame) -> DataFrame:
    """``pages`` (with url, host, path) with the lexical features and two host suffixes."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    query_part = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    host, path = F.col("host"), F.col("path")
    return pages.select(
        "*",
        F.length(url).cast("double").alias("length"), F.length(host).cast("double").alias("host_length"), count_of(path, "/").alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1))).alias("digits"), entropy(url).alias("entropy"),
        F.when(query_part == "", 0.0).otherwise(count_of(query_part, "&") + 1).alias("parameters"), F.length(query_part).cast("double").alias("query_length"),
        count_of(host, ".").alias("labels"), count_of(host, "-").alias("hyphens"), F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.substring_index(host, ".", -1).alias("suffix_1"), F.substring_index(host, ".", -2).alias("suffix_2"),
    )


def suffix_statistics(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(parts, suffix, rate) of all labelled rows, one row for each suffix of one or two parts, drawn to the mean; and the mean."""
    both = labelled.select(F.explode(F.array(*[F.struct(F.lit(k).alias("parts"), F.col(f"suffix_{k}").alias("suffix")) for k in (1, 2)])).alias("s"), "label")
    sums = written(both.groupBy("s.parts", "s.suffix").agg(F.sum("label").cast("double").alias("blocked"), F.count("*").alias("n")), "suffixes")
    total = sums.agg(F.sum("blocked").alias("b"), F.sum("n").alias("n")).first()
    mean = total["b"] / total["n"] if total["n"] else 0.5
    return sums.select("parts", "suffix", ((F.col("blocked") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("rate")), mean


def with_suffixes(shaped: DataFrame, rates: DataFrame, mean: float) -> DataFrame:
    """Rates of a checked size are broadcast; more are joined by shuffle, without the rows of frequent suffixes."""
    out = shaped
    for k, name in ((1, "short_suffix"), (2, "long_suffix")):
        suffix = f"suffix_{k}"
        named = rates.where(F.col("parts") == k).select(F.col("suffix").alias(suffix), F.col("rate").alias(name))
        if scale.fits(named):
            out = out.join(F.broadcast(named), suffix, "left")
        else:
            times = shaped.groupBy(suffix).agg(F.count("*").alias("_times"))
            out = scale.counted_lookup(out, times.join(named, suffix), [suffix], "_times", F.col("url")).drop("_times")
        out = out.withColumn(name, F.coalesce(name, F.lit(mean)))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out)


def trained(labelled: DataFrame) -> tuple[DataFrame, float, GBTClassificationModel | None]:
    """Suffix rates, their mean, and trees, from shaped rows with ``label`` 1 for block; no trees without both labels."""
    rates, mean = suffix_statistics(labelled)
    if mean in (0.0, 1.0) or not rates.take(1):
        return rates, mean, None
    h = F.xxhash64("url")
    last = labelled.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h").alias("m")).first()["m"]
    sample = with_suffixes(labelled.where(h <= last), rates, mean).select("features", F.col("label").cast("double").alias("label"))
    # copies of one url have one hash: a weight stands for them
    sample = written(sample.groupBy("features", "label").agg(F.count("*").cast("double").alias("weight")), "urls").persist()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, weightCol="weight").fit(sample) if sample.select("label").distinct().count() == 2 else None
    sample.unpersist()
    return rates, mean, trees


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row.

    ``labelled`` (url, label: 1 to block) trains the trees; by default the rows that a rule decides.
    A rule's verdict stands; else the trees block at a score of a half. Null and odd urls have
    an empty host and path, no rule, and a score like any other; equal urls get equal verdicts;
    without labels of both kinds everything is allowed that no rule blocks.
    """
    host, path = host_and_path(F.col("url"))
    plain = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"))
    shaped = with_shape(plain.withColumn("host", host).withColumn("path", path))
    ruled = shaped.withColumn("by_rule", longest_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.where(F.col("by_rule").isNotNull()).withColumn("label", (F.col("by_rule.verdict") == "block").cast("int"))
    else:
        known = with_shape(labelled.select("url", "label").withColumn("host", host).withColumn("path", path))
    rates, mean, trees = trained(known)
    scored = with_suffixes(ruled, rates, mean)
    scored = trees.transform(scored).withColumn("score", vector_to_array("probability")[1]) if trees else scored.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


@query("op2_url_trees")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
