"""How the sources of a language differ in their words.

Identical texts of a language are grouped first, with the number of times that each source has them.
Each distinct text is cut into terms once; its counts are added to every source that has it, times
those numbers. Sources are compared by the terms that both have; what either has alone
comes from how often each count occurs in a source, and terms that neither has are one product.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textspark.llm.common import query, table, texts, written

LEAST = 30  # documents of a language that have a kept term
UNIT = 1_000_000_000
PRIOR = 5
TOP = 50
HELD = 1 << 20  # summed rows, and terms, that a task holds before it hands them on

#: A-Z become a-z; ASCII other than letters parts terms.
MARKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


def collapsed(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, text, owners): each distinct text of a language once, with how often each source has it.

    Copies are summed before they move. Texts move once, one of each source; a table of digests says which
    source hands its text on, and how often each one has it.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    rows = rows.select("lang", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "source", "text")
    key = ["digest", "lang", "source"]  # sorted by it: what differs most comes first
    times = rows.groupBy(*key).agg(F.count("*").alias("n"))
    owners = times.groupBy("digest", "lang").agg(F.min("source").alias("source"), F.collect_list(F.struct("source", "n")).alias("owners"))  # one entry a source
    once = rows.groupBy(*key).agg(F.first("text").alias("text"))
    return once.join(owners.hint("merge"), key).select("lang", "text", "owners")


def term_counts(distinct: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; rows of one key are still to be added up.

    The sums of a task are handed on whenever it holds ``HELD`` rows or terms.
    """

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        held, size = [], 0

        def summed(parts):
            g, t, n, d = (np.concatenate([p[i] for p in parts]) for i in range(4))
            key, back = np.unique(g << 32 | t, return_inverse=True)
            return key >> 32, key & 0xFFFFFFFF, *(np.bincount(back, w, len(key)).astype(np.int64) for w in (n, d))

        def out(parts):
            g, t, n, d = summed(parts)
            names, words = list(groups), list(numbers)
            for i in range(0, len(g), 1 << 16):
                part = slice(i, i + (1 << 16))
                langs, sources = ([names[x][k] for x in g[part].tolist()] for k in (0, 1))
                found = pa.array([words[x] for x in t[part].tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), found, pa.array(n[part]), pa.array(d[part])], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for lang, text, owners in zip(part.column(0).to_pylist(), texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = text.translate(MARKS).split()
                    t, tf = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
                    for o in owners:
                        g = groups.setdefault((lang, o["source"]), len(groups))
                        held.append((np.full(len(t), g), t, tf * o["n"], np.full(len(t), o["n"])))
                        size += len(t)
                if size > HELD or len(numbers) > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2 or len(numbers) > HELD:
                        yield from out(held)
                        held, size = [], 0
                        groups.clear()
                        numbers.clear()
        if held:
            yield from out(held)

    rows = distinct.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exact at any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    above = F.lit(UNIT).cast("decimal(10,0)") * whole(count + PRIOR)
    return F.call_function("div", above, whole(total + PRIOR * kept)) + 1


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    ``pair``: the summed differences of all kept terms' shares to each other source of the language.
    ``term``: the ``top`` terms that the source has and whose share exceeds the language's most.
    Null text, lang and source are ''; repeated rows count each time; a group without terms has shares
    like any other; a language of one source has no pairs. Equal values go by item in byte order.
    An empty table gives no rows. Further columns are left out.
    """
    groups = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).distinct()
    # the tasks have summed their rows; all of a term meet once, to be added up and to see whether it is kept
    counts = term_counts(collapsed(docs, lang, source, text)).repartition("term", "lang")
    counts = counts.groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("term", "lang")
    counts = counts.withColumn("_docs", F.sum("docs").over(of_term)).withColumn("n_lang", F.sum("n").over(of_term))
    own = written(counts.where(F.col("_docs") >= least).select("lang", "term", "source", "n", "n_lang"), "kept-terms")
    langs = own.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_distinct("term").alias("kept"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    none = F.lit(0).cast("long")
    sizes = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = sizes.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "has", "total_lang", "kept")])
    # share of a term that the source does not have; without kept terms nothing is asked of it
    sizes = written(sizes.withColumn("zero", F.when(F.col("kept") > 0, share(none, F.col("total"), F.col("kept"))).otherwise(none)), "groups")
    own = own.join(sizes, ["lang", "source"])
    own = own.select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"))
    own = written(own, "shares")

    a = sizes.select("lang", *[F.col(c).alias(f"a_{c}") for c in ("source", "has", "zero")], "kept")
    b = sizes.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("source", "has", "zero")])
    pairs = a.join(b, "lang").where(F.col("a_source") != F.col("b_source"))  # each is a row of the result
    x = own.select("lang", "term", *[F.col(c).alias(f"a_{c}") for c in ("source", "p", "zero")])
    y = own.select("lang", "term", *[F.col(c).alias(f"b_{c}") for c in ("source", "p", "zero")])
    gap = lambda c, d: F.abs(F.col(c) - F.col(d))
    both = x.join(y, ["lang", "term"]).where(F.col("a_source") < F.col("b_source"))
    both = both.groupBy("lang", "a_source", "b_source").agg(F.sum(gap("a_p", "b_p") - gap("a_p", "b_zero") - gap("b_p", "a_zero") + gap("a_zero", "b_zero")).alias("shared"))
    both = both.unionByName(both.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), "shared"))
    # differences of a source's terms to a source without them, once for each share that occurs
    levels = own.groupBy("lang", "source", "p").agg(F.count("*").alias("times")).withColumnRenamed("source", "a_source")
    alone = levels.join(b, "lang").where(F.col("a_source") != F.col("b_source")).groupBy("lang", "a_source", "b_source").agg(F.sum(F.col("times") * gap("p", "b_zero")).alias("alone"))
    back = alone.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), F.col("alone").alias("alone_b"))
    key = ["lang", "a_source", "b_source"]
    full = pairs.join(both, key, "left").join(alone, key, "left").join(back, key, "left")
    known = lambda c: F.coalesce(c, none)
    value = known("shared") + known("alone") + known("alone_b") + (F.col("kept") - F.col("a_has") - F.col("b_has")) * gap("a_zero", "b_zero")
    pair = full.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), value.cast("long").alias("value"))
    term = own.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))


OP12 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
words AS (
  SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST}),
langs AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
cells AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT} * (coalesce(c.n, 0) + {PRIOR})) // (g.total + {PRIOR} * l.v) AS p, 1 + ({UNIT} * (k.n + {PRIOR})) // (l.total + {PRIOR} * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(g.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""


@query("op12_source_divergence", OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
