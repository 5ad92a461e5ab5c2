"""Corpus statistics over token arrays: frequencies, vocabularies, weights, collocations, encodings."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let, unnest
from ..functions.text import normalised_words, pos_tag, stem
from ..resources import values as V
from .scale import checkpointed, counted_lookup, exact_quantiles, global_position, lookup, sized_broadcast, top_k
from .words import looked_up

# ---------------------------------------------------------------- frequencies


def term_rows(df: DataFrame, tokens: str, keep: Sequence[str] = ()) -> DataFrame:
    return unnest(df, keep, F.col(tokens), "term")


def term_frequency(df: DataFrame, tokens: str) -> DataFrame:
    """(term, frequency) over the whole corpus; counted per task before the shuffle."""
    return term_rows(df, tokens).groupBy("term").agg(F.count("*").alias("frequency"))


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """(term, frequency, index): index 0 is the most frequent term, ties in term order."""
    ranked = global_position(term_frequency(df, tokens), [F.desc("frequency"), F.asc("term")], "_pos")
    return ranked.select("term", "frequency", (F.col("_pos") - 1).alias("index"))


def top_terms(df: DataFrame, tokens: str, n: int = 50) -> DataFrame:
    return term_frequency(df, tokens).orderBy(F.desc("frequency"), "term").limit(n)


def group_terms(df: DataFrame, group: str, tokens: str, n: int) -> DataFrame:
    """The n most frequent terms of every group."""
    counted = term_rows(df, tokens, [group]).groupBy(group, "term").agg(F.count("*").alias("frequency"))
    return top_k(counted, [group], [F.desc("frequency"), F.asc("term")], n)


def vocab_summary(df: DataFrame, key: str, tokens: str, approximate: bool = False) -> DataFrame:
    """Documents, tokens and distinct terms."""
    if approximate:
        distinct = F.approx_count_distinct("term")
        return df.select(key, F.explode_outer(tokens).alias("term")).agg(
            F.approx_count_distinct(key).alias("n_docs"), F.count("term").alias("n_tokens"), distinct.alias("n_terms")
        )
    terms = term_frequency(df, tokens).agg(F.count("*").alias("n_terms"))
    sizes = df.agg(F.count("*").alias("n_docs"), F.sum(F.greatest(F.size(tokens), F.lit(0))).cast("bigint").alias("n_tokens"))
    one = F.lit(1).alias("_one")
    return sizes.select("*", one).join(terms.select("*", one), "_one").drop("_one")


# ---------------------------------------------------------------- counts and weights in long form


def bag_of_words(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, n)."""
    return term_rows(df, tokens, [key]).groupBy(key, "term").agg(F.count("*").alias("n"))


def document_frequency(bag: DataFrame) -> DataFrame:
    return bag.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("frequency"))


def count_vectors(df: DataFrame, key: str, tokens: str, vocab_size: int | None = None, min_df: int = 1, min_tf: int = 1) -> DataFrame:
    """(key, term, n) restricted to the kept vocabulary: the most frequent terms found in at least ``min_df`` documents."""
    bag = bag_of_words(df, key, tokens)
    if vocab_size is None and min_df <= 1:
        return bag.filter(F.col("n") >= min_tf)
    bag = checkpointed(bag)  # the texts are read once
    kept = document_frequency(bag).filter(F.col("n_docs") >= min_df)
    if vocab_size is not None:
        kept = kept.orderBy(F.desc("frequency"), "term").limit(vocab_size)
    bag = bag.filter(F.col("n") >= min_tf)
    return counted_lookup(bag, kept, ["term"], "n_docs", F.col(key)).filter(F.col("n_docs").isNotNull()).select(key, "term", "n")


def tf_idf(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, n, weight) with weight = n · ln((N + 1) / (df + 1))."""
    n_docs = df.count()
    bag = checkpointed(bag_of_words(df, key, tokens))  # the texts are read once
    joined = counted_lookup(bag, document_frequency(bag).select("term", "n_docs"), ["term"], "n_docs", F.col(key))
    return joined.select(key, "term", "n", (F.col("n") * F.log(F.lit(float(n_docs + 1)) / (F.col("n_docs") + 1))).alias("weight"))


def tf_idf_l2(df: DataFrame, key: str, tokens: str, max_df: float = 0.95, top: int | None = None) -> DataFrame:
    """Smoothed weights n · (ln((1 + N) / (1 + df)) + 1), rows scaled to length 1; of all terms, or the ``top`` most frequent ones."""
    n_docs = df.count()
    bag = checkpointed(bag_of_words(df, key, tokens))
    kept = document_frequency(bag).filter(F.col("n_docs") <= max_df * n_docs)
    if top is not None:
        kept = kept.orderBy(F.desc("frequency"), "term").limit(top)
    joined = counted_lookup(bag, kept.select("term", "n_docs"), ["term"], "n_docs", F.col(key)).filter(F.col("n_docs").isNotNull())
    weighted = joined.withColumn("_w", F.col("n") * (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("n_docs"))) + 1))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / length).alias("weight"))


def class_tf_idf(df: DataFrame, cluster: str, tokens: str) -> DataFrame:
    """(cluster, term, n, weight) with weight = n · ln(1 + A / f); A is the mean number of words per cluster."""
    counts = checkpointed(term_rows(df, tokens, [cluster]).groupBy(cluster, "term").agg(F.count("*").alias("n")))
    total = counts.groupBy("term").agg(F.sum("n").alias("f"), F.count("*").alias("_classes"))
    average = counts.agg((F.sum("n") / F.count_distinct(cluster)).alias("a")).first()["a"]
    joined = counted_lookup(counts, total, ["term"], "_classes", F.col(cluster))
    return joined.select(cluster, "term", "n", (F.col("n") * F.log(1 + F.lit(float(average or 0.0)) / F.col("f"))).alias("weight"))


# ---------------------------------------------------------------- dictionaries and encodings


def dictionary(df: DataFrame, key: str, tokens: str, no_below: int = 1, bag: DataFrame | None = None) -> DataFrame:
    """(term, n_docs, term_id): ids in term order, rare terms left out; from ``bag`` where the caller has counted the rows already."""
    kept = document_frequency(bag_of_words(df, key, tokens) if bag is None else bag).filter(F.col("n_docs") >= no_below).select("term", "n_docs")
    return global_position(kept, [F.col("term")], "_pos").select("term", "n_docs", (F.col("_pos") - 1).alias("term_id"))


def doc2bow(df: DataFrame, key: str, tokens: str, terms: DataFrame, bag: DataFrame | None = None) -> DataFrame:
    """(key, term_id, n) for the terms of the dictionary; from ``bag`` where the caller has counted the rows already."""
    bag = bag_of_words(df, key, tokens) if bag is None else bag
    joined = counted_lookup(bag, terms, ["term"], "n_docs", F.col(key))
    return joined.filter(F.col("term_id").isNotNull()).select(key, "term_id", "n")


def training_vocab(df: DataFrame, tokens: str, min_count: int = 5, max_words: int | None = None) -> DataFrame:
    """(term, id): words by (count, word) descending, numbered after the special symbols; all words unless the caller sets a limit."""
    spark = df.sparkSession
    order = [F.desc("frequency"), F.desc("term")]
    kept = term_frequency(df, tokens).filter(F.col("frequency") >= min_count)
    if max_words is not None:
        kept = kept.orderBy(*order).limit(max_words)
    numbered = global_position(kept, order, "_pos").select("term", (F.col("_pos") - 1 + len(V.VOCAB_SYMBOLS)).alias("id"))
    symbols = spark.createDataFrame([(s, i) for i, s in enumerate(V.VOCAB_SYMBOLS)], "term string, id long")
    return symbols.unionByName(numbered)


def encode(df: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int = 1, out: str = "ids") -> DataFrame:
    """(key, ids): token ids in text order, unknown words as 1; looked up in the row."""
    found = looked_up(df.select(key, tokens), tokens, vocab, "term", "id", out)
    return found.select(key, F.transform(out, lambda i: F.coalesce(i, F.lit(unknown).cast(vocab.schema["id"].dataType))).alias(out))


def length_buckets(df: DataFrame, ids: str, batch: int) -> DataFrame:
    """Adds ``bucket`` (NULL when longer than every bucket) and ids padded with 0 to the bucket length.

    A bucket is a length shared by at least ``batch`` rows. The table of lengths has
    one row per distinct length, so it is small whatever the corpus size.
    """
    sized = df.withColumn("_len", F.size(ids))
    lengths = sized.groupBy("_len").agg(F.count("*").alias("_n"))
    upward = Window.orderBy("_len").rowsBetween(0, Window.unboundedFollowing)
    buckets = lengths.select("_len", F.min(F.when(F.col("_n") >= batch, F.col("_len"))).over(upward).alias("bucket"))
    joined = sized.join(sized_broadcast(buckets), "_len", "left")
    pad = F.array_repeat(F.lit(0), F.greatest(F.col("bucket") - F.col("_len"), F.lit(0)).cast("int"))
    return joined.withColumn("padded", F.when(F.col("bucket").isNotNull(), F.concat(F.col(ids), pad))).drop("_len")


# ---------------------------------------------------------------- lemmas, stems, tags


def lemmatise(df: DataFrame, key: str, tokens: str, lemmas: DataFrame, out: str = "lemmas", distinct: bool = False) -> DataFrame:
    """(key, lemmas): dictionary (form, lemma) applied to every token in the row; unknown tokens stay."""
    found = looked_up(df.select(key, tokens), tokens, lemmas, "form", "lemma", "_lemma")
    words = F.zip_with(F.coalesce(tokens, F.array().cast("array<string>")), "_lemma", lambda t, known: F.coalesce(known, t))
    return found.select(key, (F.array_distinct(words) if distinct else words).alias(out))


def normalise_text(df: DataFrame, text: str, lemmas: DataFrame, out: str = "normalised", stop_words: Sequence[str] = V.STOP_WORDS) -> DataFrame:
    """``df`` with its text without punctuation and stop words, each word as its lemma (form, lemma) in any case; looked up in the row."""
    words = df.withColumn("_words", F.coalesce(normalised_words(F.col(text), stop_words), F.array().cast("array<string>")))
    found = looked_up(words.withColumn("_low", F.transform("_words", lambda w: F.lower(w))), "_low", lemmas, "form", "lemma", "_lemma")
    return found.withColumn(out, F.array_join(F.zip_with("_words", "_lemma", lambda w, known: F.coalesce(known, w)), " ")).drop("_words", "_low", "_lemma")


def parse_lemmas(lines: DataFrame, col: str = "value") -> DataFrame:
    """``lemma->form<TAB>form…`` lines to (form, lemma); one lemma per form."""
    parts = F.split(F.col(col), "->")
    rows = lines.filter(F.col(col).contains("->")).select(
        F.trim(F.get(parts, 0)).alias("lemma"), F.explode(F.split(F.trim(F.get(parts, 1)), r"\t")).alias("form")
    )
    return rows.filter(F.col("form") != "").groupBy("form").agg(F.min("lemma").alias("lemma"))


def stems(df: DataFrame, tokens: str, out: str = "stems") -> DataFrame:
    """Suffix rules on every token, inside the row."""
    return df.withColumn(out, F.transform(tokens, stem))


def stem_vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """(term, stem) of every distinct token."""
    return term_rows(df, tokens).distinct().withColumn("stem", stem(F.col("term")))


def with_pos_tags(df: DataFrame, tokens: str, lexicon: DataFrame | None = None, out: str = "tags") -> DataFrame:
    """``df`` with tags by lexicon (term, tag), looked up in the row; suffix rules for unknown words."""
    if lexicon is None:
        return df.withColumn(out, F.transform(tokens, lambda t: pos_tag(t)))
    found = looked_up(df.withColumn("_low", F.transform(tokens, lambda t: F.lower(t))), "_low", lexicon, "term", "tag", "_tag")
    tags = F.zip_with(F.coalesce(tokens, F.array().cast("array<string>")), "_tag", lambda t, known: pos_tag(t, known))
    return found.withColumn(out, tags).drop("_low", "_tag")


def pos_tags(df: DataFrame, key: str, tokens: str, lexicon: DataFrame | None = None, out: str = "tags") -> DataFrame:
    """(key, tags)."""
    return with_pos_tags(df.select(key, tokens), tokens, lexicon, out).select(key, out)


# ---------------------------------------------------------------- collocations


def collocations(df: DataFrame, tokens: str, min_count: int = 2, threshold: float = 10.0) -> DataFrame:
    """(a, b, n, score): adjacent pairs with (n − min_count) · V / (n_a · n_b) above the threshold.

    V counts distinct words and distinct pairs, as both are entries of the phrase vocabulary.
    Every token is the first of exactly one pair (the last one of a text with nothing behind
    it), so the word counts are sums over the pair counts and the texts are read once.
    """
    pairs = checkpointed(_pair_rows(df, tokens).groupBy("a", "b").agg(F.count("*").alias("n")))
    ones = checkpointed(pairs.groupBy("a").agg(F.sum("n").alias("frequency")))
    real = pairs.filter(F.col("b").isNotNull())
    size = ones.count() + real.count()
    frequent = real.filter(F.col("n") >= min_count)
    left = lookup(frequent, ones.withColumnRenamed("frequency", "n_a"), ["a"], F.col("b"))
    both = lookup(left, ones.select(F.col("a").alias("b"), F.col("frequency").alias("n_b")), ["b"], F.col("a"))
    score = (F.col("n") - min_count) / F.col("n_a") / F.col("n_b") * F.lit(float(size))
    return both.withColumn("score", score).filter(F.col("score") > threshold).select("a", "b", "n", "score")


def _pair_rows(df: DataFrame, tokens: str, keep: Sequence[str] = ()) -> DataFrame:
    """(pos, a, b) for every token and the one behind it, NULL behind the last."""

    def pairs(arr: Column) -> Column:
        return F.transform(arr, lambda t, i: F.struct(i.alias("pos"), t.alias("a"), F.get(arr, i + 1).alias("b")))

    return unnest(df, keep, let(F.col(tokens), pairs), "_p").select(*keep, "_p.*")


def join_collocations(df: DataFrame, key: str, tokens: str, pairs: DataFrame, delimiter: str = "_", out: str = "phrases") -> DataFrame:
    """(key, phrases): kept pairs joined from the left; a token belongs to one pair at most. Pairs are looked up in the row."""
    both = lambda a, b: F.concat(a, F.lit("\x1f"), b)
    neighbours = F.zip_with(F.col(tokens), F.slice(F.col(tokens), F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), both)
    table = pairs.select(both(F.col("a"), F.col("b")).alias("pair"), F.lit(True).alias("_hit"))
    found = looked_up(df.select(key, tokens, neighbours.alias("_pairs")), "_pairs", table, "pair", "_hit", "_hits")

    @F.pandas_udf("array<string>")
    def joined(words: pd.Series, hits: pd.Series) -> pd.Series:
        def walk(own, heads):
            if own is None:
                return None
            phrases, i = [], 0
            while i < len(own):
                step = 2 if heads[i] else 1
                phrases.append(delimiter.join(own[i : i + step]))
                i += step
            return phrases

        return pd.Series([walk(a, b) for a, b in zip(words, hits, strict=True)])

    return found.select(key, joined(F.col(tokens), F.col("_hits")).alias(out))


# ---------------------------------------------------------------- reports


def label_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Rows of ``a``, one column per listed value of ``b``, zero filled."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == F.lit(v)).alias(str(v)) for v in values])


def share_of_parent(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, child, n, percent of the parent)."""
    counted = checkpointed(df.groupBy(parent, child).agg(F.count("*").alias("n")))
    totals = counted.groupBy(parent).agg(F.sum("n").alias("_total"), F.count("*").alias("_children"))
    joined = counted_lookup(counted, totals, [parent], "_children", F.col(child))
    return joined.select(parent, child, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 4).alias("percent"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """Mean, median, population deviation, 1st and 99th percentile; computed from the table of distinct lengths."""
    counted = df.select(length.cast("bigint").alias("_v")).groupBy("_v").agg(F.count("*").alias("_n"))
    total, weighted = F.sum("_n"), F.sum(F.col("_v") * F.col("_n"))
    square = F.sum(F.col("_v") * F.col("_v") * F.col("_n")).cast("double")
    q = F.percentile("_v", F.array(F.lit(0.5), F.lit(0.01), F.lit(0.99)), F.col("_n"))
    staged = counted.agg(total.alias("n"), (weighted / total).alias("mean"), (square / total).alias("_sq"), q.alias("_q"))
    return staged.select(
        "n",
        F.round("mean", 6).alias("mean"),
        F.get("_q", 0).alias("median"),
        F.round(F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))), 6).alias("std"),
        F.round(F.get("_q", 1), 6).alias("p01"),
        F.round(F.get("_q", 2), 6).alias("p99"),
    )


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts per equal-width bin between the overall minimum and maximum; the last bin includes the maximum."""
    edge = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    if edge["lo"] is None:
        return df.select(*([by] if by else []), F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("n")).limit(0)
    width = (edge["hi"] - edge["lo"]) / bins or 1.0
    index = F.least(F.floor((F.col(col).cast("double") - F.lit(edge["lo"])) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    group = [F.col(by)] if by else []
    return df.filter(F.col(col).isNotNull()).groupBy(*group, index.alias("bin")).agg(F.count("*").alias("n"))


def melt(df: DataFrame, label: str, components: Sequence[str]) -> DataFrame:
    return df.select(label, *components).unpivot([label], list(components), "component", "score")


def component_quartiles(df: DataFrame, label: str, components: Sequence[str]) -> DataFrame:
    """Exact quartiles of every score component per label."""
    return exact_quantiles(melt(df, label, components), "score", [0.25, 0.5, 0.75], [label, "component"])


def series_summary(df: DataFrame, col: str) -> DataFrame:
    return df.agg(
        F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_samp(col), 6).alias("std")
    )


def topic_sizes(df: DataFrame, topic: str) -> DataFrame:
    """Documents per topic without outliers (−1), with outlier and topic totals on every row."""
    counted = df.groupBy(topic).agg(F.count("*").alias("doc_count"))
    totals = df.agg(F.count_if(F.col(topic) == -1).alias("outliers"), F.count_distinct(F.when(F.col(topic) != -1, F.col(topic))).alias("topics"))
    one = F.lit(1).alias("_one")
    return counted.filter(F.col(topic) != -1).select("*", one).join(F.broadcast(totals.select("*", one)), "_one").drop("_one")


def threshold_sweep(keywords: DataFrame, score: str, overlaps: str, thresholds: Sequence[float] = (0.5, 1.0, 1.5, 2.5)) -> DataFrame:
    """Keywords at or below each threshold, all and those that overlap an entity, from one pass."""
    parts = []
    for t in thresholds:
        ok = F.col(score) <= F.lit(float(t))
        parts += [F.count_if(ok).alias(f"all_{t}"), F.count_if(ok & F.col(overlaps)).alias(f"kept_{t}")]
    row = keywords.agg(*parts)
    stacked = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"`all_{t}`").alias("n_keywords"), F.col(f"`kept_{t}`").alias("n_kept")) for t in thresholds])
    return row.select(F.inline(stacked))
