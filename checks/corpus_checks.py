"""Corpus statistics, vocabularies, keywords, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.functions import text as T
from textspark.functions.expr import string_array
from textspark.operators import corpus, tagger
from textspark.operators.scale import checkpointed
from textspark.resources import values as V

from .base import documents, lit, query, spread, table
from .text_checks import CONTENT, NORMALISED, STOPS, TOKENS

col = F.col


def toks(spark, sf):
    """Content tokens of every document."""
    return spread(documents(spark, sf)).select("doc_id", "lang", "source", T.content_tokens(col("text")).alias("tokens"))


TERMS = f"t AS (SELECT doc_id, lang, source, unnest({CONTENT}) AS term, generate_subscripts({CONTENT}, 1) AS i FROM documents)"


@query("ag4_term_frequency", f"WITH {TERMS} SELECT term, count(*) AS frequency FROM t GROUP BY term")
def _(spark, sf):
    return corpus.term_frequency(toks(spark, sf), "tokens")


@query("kw8_vocabulary_index", f"WITH {TERMS} SELECT term, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS index FROM t GROUP BY term")
def _(spark, sf):
    return corpus.vocabulary(toks(spark, sf), "tokens")


@query("ag5_top_terms", f"WITH {TERMS} SELECT term, count(*) AS frequency FROM t GROUP BY term ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, sf):
    return corpus.top_terms(toks(spark, sf), "tokens", 50)


@query(
    "ag6_grouped_term_clouds",
    f"WITH {TERMS}, g AS (SELECT lang, term, count(*) AS frequency FROM t GROUP BY lang, term) SELECT lang, term, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY frequency DESC, term) AS rank FROM g) WHERE rank <= 80",
)
def _(spark, sf):
    return corpus.group_terms(toks(spark, sf), "lang", "tokens", 80).withColumn("rank", col("rank").cast("bigint"))


@query("wn7_top_k_per_topic", f"WITH {TERMS}, g AS (SELECT source, term, count(*) AS frequency FROM t GROUP BY source, term) SELECT source, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY frequency DESC, term) AS rank FROM g) WHERE rank <= 10")
def _(spark, sf):
    return corpus.group_terms(toks(spark, sf), "source", "tokens", 10).select("source", "term", col("rank").cast("bigint").alias("rank"))


@query("ag16_vocabulary_size", f"WITH {TERMS} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t")
def _(spark, sf):
    return corpus.vocab_summary(toks(spark, sf), "doc_id", "tokens")


@query("kw5_count_vectors", f"WITH {TERMS} SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term")
def _(spark, sf):
    return corpus.count_vectors(toks(spark, sf), "doc_id", "tokens")


@query(
    "kw5_count_vectors_limited",
    f"WITH {TERMS}, b AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term), k AS (SELECT term FROM b GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 300) SELECT doc_id, term, n FROM b JOIN k USING (term) WHERE n >= 4",
)
def _(spark, sf):
    return corpus.count_vectors(toks(spark, sf), "doc_id", "tokens", vocab_size=300, min_df=2, min_tf=4)


BAG = f"{TERMS}, b AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term), df AS (SELECT term, count(*) AS d, sum(n) AS f FROM b GROUP BY term)"


@query("kw6_tf_idf", f"WITH {BAG} SELECT doc_id, term, n, round(n * ln(((SELECT count(*) FROM documents) + 1.0) / (d + 1)), 6) AS weight FROM b JOIN df USING (term)")
def _(spark, sf):
    return corpus.tf_idf(toks(spark, sf), "doc_id", "tokens").withColumn("weight", F.round("weight", 6))


@query(
    "kw7_tf_idf_l2",
    f"WITH {BAG}, k AS (SELECT term, d FROM df WHERE d <= 0.95 * (SELECT count(*) FROM documents)), w AS (SELECT doc_id, term, n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + d)) + 1) AS w FROM b JOIN k USING (term)) "
    "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
)
def _(spark, sf):
    return corpus.tf_idf_l2(toks(spark, sf), "doc_id", "tokens").withColumn("weight", F.round("weight", 6))


@query(
    "tm10_class_tf_idf",
    f"WITH {TERMS}, c AS (SELECT source, term, count(*) AS n FROM t GROUP BY source, term), f AS (SELECT term, sum(n) AS f FROM c GROUP BY term) SELECT source, term, n, round(n * ln(1 + (SELECT sum(n) * 1.0 / count(DISTINCT source) FROM c) / f), 6) AS weight FROM c JOIN f USING (term)",
)
def _(spark, sf):
    return corpus.class_tf_idf(toks(spark, sf), "source", "tokens").withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- dictionaries, encodings


@query("tx21_build_dictionary", f"WITH {BAG}, k AS (SELECT term, d, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df WHERE d >= 3) SELECT doc_id, term_id, n FROM b JOIN k USING (term)")
def _(spark, sf):
    t = toks(spark, sf)
    bag = checkpointed(corpus.bag_of_words(t, "doc_id", "tokens"))  # the texts are read once
    return corpus.doc2bow(t, "doc_id", "tokens", corpus.dictionary(t, "doc_id", "tokens", no_below=3, bag=bag), bag)


VOCAB = f"v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term DESC) + 3 AS id FROM t GROUP BY term HAVING count(*) >= 5)"
SPECIAL = " UNION ALL ".join(f"SELECT {lit(s)}, {i}" for i, s in enumerate(V.VOCAB_SYMBOLS))


@query("tx22_training_vocab", f"WITH {TERMS}, {VOCAB} SELECT term, id FROM v UNION ALL {SPECIAL}")
def _(spark, sf):
    return corpus.training_vocab(toks(spark, sf), "tokens").withColumn("id", col("id").cast("bigint"))


ENCODED = f"WITH {TERMS}, {VOCAB}, e AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY i) AS ids FROM t LEFT JOIN v USING (term) GROUP BY doc_id)"


def encoded(spark, sf):
    t = toks(spark, sf)
    return corpus.encode(t, "doc_id", "tokens", corpus.training_vocab(t, "tokens"))


@query("tx23_encode_tokens", f"{ENCODED} SELECT d.doc_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM documents d LEFT JOIN e USING (doc_id)")
def _(spark, sf):
    return encoded(spark, sf).select("doc_id", F.array_join(col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "tx24_length_buckets",
    f"{ENCODED}, l AS (SELECT d.doc_id, coalesce(len(ids), 0) AS n FROM documents d LEFT JOIN e USING (doc_id)), k AS (SELECT n FROM l GROUP BY n HAVING count(*) >= 4) "
    "SELECT doc_id, coalesce((SELECT min(k.n) FROM k WHERE k.n >= l.n), -1) AS bucket, coalesce((SELECT min(k.n) FROM k WHERE k.n >= l.n), -1) AS padded_length FROM l",
)
def _(spark, sf):
    out = corpus.length_buckets(encoded(spark, sf).persist(), "ids", 4)
    size = F.when(col("padded").isNotNull(), F.size("padded")).otherwise(-1)
    return out.select("doc_id", F.coalesce("bucket", F.lit(-1)).cast("bigint").alias("bucket"), size.cast("bigint").alias("padded_length"))


# ---------------------------------------------------------------- lemmas, stems, tags

LEMMA_SQL = (
    r"lm AS (SELECT form, min(regexp_replace(form, '(?:tion|ing|ed|er|es|s)$', '')) AS lemma FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM benchmark) "
    r"WHERE regexp_matches(form, '...(?:tion|ing|ed|er|es|s)$') GROUP BY form)"
)


def lemma_table(spark, sf):
    """Dictionary (form, lemma) of the benchmark words: the form without its ending."""
    form = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("form")
    words = table(spark, sf, "benchmark").select(form).filter(col("form").rlike(r"...(?:tion|ing|ed|er|es|s)$")).distinct()
    return words.withColumn("lemma", F.regexp_replace("form", r"(?:tion|ing|ed|er|es|s)$", ""))


@query("tx10_lemmatise", f"WITH {TERMS}, {LEMMA_SQL} SELECT d.doc_id, coalesce(l, '') AS lemmas FROM documents d LEFT JOIN (SELECT doc_id, string_agg(coalesce(lemma, term), ' ' ORDER BY i) AS l FROM t LEFT JOIN lm ON form = term GROUP BY doc_id) USING (doc_id)")
def _(spark, sf):
    out = corpus.lemmatise(toks(spark, sf), "doc_id", "tokens", lemma_table(spark, sf))
    return out.select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@query(
    "tx3_normalise_with_lemmas",
    f"WITH {LEMMA_SQL}, w AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN {STOPS}) AS x FROM documents)) "
    "SELECT d.doc_id, coalesce(n, '') AS normalised FROM documents d LEFT JOIN (SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS n FROM w LEFT JOIN lm ON form = lower(w) GROUP BY doc_id) USING (doc_id)",
)
def _(spark, sf):
    return corpus.normalise_text(spread(documents(spark, sf)), "text", lemma_table(spark, sf)).select("doc_id", "normalised")


@query("jn3_dictionary_join", f"WITH {TERMS}, {LEMMA_SQL} SELECT lemma, count(*) AS n, count(DISTINCT term) AS forms FROM t JOIN lm ON form = term GROUP BY lemma")
def _(spark, sf):
    from textspark.operators.scale import lookup

    rows = corpus.term_rows(toks(spark, sf), "tokens", ["doc_id"])
    hits = lookup(rows, lemma_table(spark, sf).withColumnRenamed("form", "term"), ["term"], col("doc_id"), how="inner")
    return hits.groupBy("lemma", "term").agg(F.count("*").alias("m")).groupBy("lemma").agg(F.sum("m").alias("n"), F.count("*").alias("forms"))


STEM_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(term), 'sses$', 'ss'), 'ies$', 'i'), '([^s])s$', '\\1'), '([a-z]{3})(?:ed|ing|ly)$', '\\1'), '([a-z]{3})ation$', '\\1ate'), '([a-z]{3})ness$', '\\1')"


@query("tx11_stem_vocabulary", f"WITH {TERMS} SELECT DISTINCT term, {STEM_SQL} AS stem FROM t")
def _(spark, sf):
    return corpus.stem_vocabulary(toks(spark, sf), "tokens")


TAGS = ["NN", "JJ", "VB", "ADP", "DET"]
GUESS_SQL = r"""CASE WHEN NOT regexp_matches(term, '[\p{L}\p{N}]') THEN 'PUNCT' WHEN regexp_matches(term, '^[0-9][0-9.,]*$') THEN 'CD' WHEN regexp_matches(lower(term), 'ly$') THEN 'RB'
  WHEN regexp_matches(lower(term), 'ing$') THEN 'VBG' WHEN regexp_matches(lower(term), 'ed$') THEN 'VBD' WHEN regexp_matches(lower(term), '(?:ous|ful|able|ible|ive|al|ic)$') THEN 'JJ'
  WHEN regexp_matches(lower(term), '(?:tion|ment|ness|ity|ship)$') THEN 'NN' WHEN regexp_matches(lower(term), 's$') THEN 'NNS' ELSE 'NN' END"""
LEXICON_SQL = "lx AS (SELECT DISTINCT w, (" + "[" + ", ".join(lit(t) for t in TAGS) + "]" + ")[('0x' || substring(md5(w), 1, 8))::BIGINT % 5 + 1] AS tag FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark))"
RAW_TERMS = f"r AS (SELECT doc_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS i FROM documents)"
TAGGED_SQL = f"{RAW_TERMS}, {LEXICON_SQL}, g AS (SELECT doc_id, term, i, coalesce(tag, {GUESS_SQL}) AS tag FROM r LEFT JOIN lx ON w = lower(term))"


def tag_lexicon(spark, sf):
    """Tag lexicon of the benchmark words, the tag chosen by a digest of the word."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")
    words = table(spark, sf, "benchmark").select(word).distinct()
    index = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint"), F.lit(5)).cast("int")
    return words.withColumn("tag", F.get(string_array(TAGS), index))


def tagged(spark, sf):
    raw = spread(documents(spark, sf)).select("doc_id", T.tokens(col("text")).alias("tokens"))
    return corpus.with_pos_tags(raw, "tokens", tag_lexicon(spark, sf))


@query(
    "tx15_tag_transitions",
    f"WITH {TAGGED_SQL}, n AS (SELECT coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY i), '<s>') AS before, tag FROM g) SELECT before, tag, count(*) AS n FROM n GROUP BY ALL",
)
def _(spark, sf):
    return tagger.transition_counts(tagged(spark, sf), "tags")


@query("tx15_tag_words", f"WITH {TAGGED_SQL} SELECT lower(term) AS term, tag, count(*) AS n FROM g GROUP BY ALL")
def _(spark, sf):
    return tagger.word_counts(tagged(spark, sf), "tokens", "tags")


@query("tx15_tag_model", f"WITH {TAGGED_SQL} SELECT doc_id, count(*) AS n, true AS known_tags FROM g WHERE doc_id % 2 = 1 GROUP BY doc_id")
def _(spark, sf):
    """Every token of the other half of the documents gets one of the tags that the model was counted from."""
    docs = tagged(spark, sf)
    model = tagger.train_tagger(docs.where("doc_id % 2 = 0"), "tokens", "tags")
    found = tagger.tag_rows(docs.where("doc_id % 2 = 1").select("doc_id", "tokens"), "tokens", model)
    return found.where(F.size("tags") > 0).select("doc_id", F.size("tags").cast("bigint").alias("n"), F.forall("tags", lambda t: t.isin(*model.tags)).alias("known_tags"))


@query("tx15_pos_tag", f"WITH {TAGGED_SQL} SELECT tag, count(*) AS n, count(DISTINCT term) AS terms FROM g GROUP BY tag")
def _(spark, sf):
    pairs = tagged(spark, sf).select(F.explode(F.arrays_zip("tokens", "tags")).alias("p"))
    per_term = pairs.groupBy(col("p.tags").alias("tag"), col("p.tokens").alias("term")).agg(F.count("*").alias("m"))
    return per_term.groupBy("tag").agg(F.sum("m").alias("n"), F.count("*").alias("terms"))


@query("tx16_filter_pos_unigrams", f"WITH {TAGGED_SQL} SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS kept FROM g WHERE tag IN ('JJ', 'NN', 'NNS', 'VB', 'VBP') GROUP BY doc_id")
def _(spark, sf):
    out = tagged(spark, sf).select("doc_id", T.filter_pos(col("tokens"), col("tags")).alias("k"))
    return out.filter(F.size("k") > 0).select("doc_id", F.array_join("k", " ").alias("kept"))


@query(
    "tx17_filter_pos_ngrams",
    f"WITH {TAGGED_SQL}, w AS (SELECT *, lead(term) OVER p AS t2, lead(term, 2) OVER p AS t3, lead(tag) OVER p AS g2, lead(tag, 2) OVER p AS g3 FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY i)), "
    "u AS (SELECT term || '_' || t2 AS gram FROM w WHERE tag IN ('JJ', 'NN', 'NNS', 'VB', 'VBP') AND g2 IN ('JJ', 'NN', 'NNS') "
    "UNION ALL SELECT term || '_' || t2 || '_' || t3 FROM w WHERE tag IN ('JJ', 'NN', 'NNS', 'VB', 'VBP') AND g2 IN ('JJ', 'NN', 'NNS', 'VB', 'VBP') AND g3 IN ('NN', 'NNS')) SELECT gram, count(*) AS n FROM u GROUP BY gram",
)
def _(spark, sf):
    df = tagged(spark, sf).select(T.ngrams(col("tokens"), 3).alias("grams"), T.ngrams(col("tags"), 3).alias("tag_grams"))
    return df.select(F.explode(T.filter_pos_ngrams(col("grams"), col("tag_grams"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("tx18_visible_tags", f"WITH {TAGGED_SQL} SELECT doc_id, count(*) AS n FROM g WHERE tag NOT IN ('PUNCT', 'ADP', 'DET', 'CCONJ', 'PART', 'X') GROUP BY doc_id")
def _(spark, sf):
    return tagged(spark, sf).select("doc_id", F.size(T.visible_tags(col("tags"))).cast("bigint").alias("n")).filter("n > 0")


# ---------------------------------------------------------------- collocations

PAIRS_SQL = (
    f"w AS (SELECT doc_id, unnest({NORMALISED}) AS a, generate_subscripts({NORMALISED}, 1) AS i FROM documents), p AS (SELECT doc_id, i, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w), "
    "u AS (SELECT a, count(*) AS n FROM w GROUP BY a), c AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b), "
    "s AS (SELECT c.a, c.b, c.n, (c.n - 5) * 1.0 / x.n / y.n * ((SELECT count(*) FROM u) + (SELECT count(*) FROM c)) AS score FROM c JOIN u x ON x.a = c.a JOIN u y ON y.a = c.b WHERE c.n >= 5)"
)


def plain(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", T.normalise_tokens(T.tokens(col("text"))).alias("tokens"))


@query("tx20_collocations", f"WITH {PAIRS_SQL} SELECT a, b, n, round(score, 6) AS score FROM s WHERE score > 10")
def _(spark, sf):
    return corpus.collocations(plain(spark, sf), "tokens", 5, 10.0).withColumn("score", F.round("score", 6))


@query(
    "tx20_join_collocations",
    f"WITH RECURSIVE {PAIRS_SQL}, k AS (SELECT a, b FROM s WHERE score > 10), h AS (SELECT doc_id, i FROM p JOIN k USING (a, b)), "
    "g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h), "
    "st AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS r FROM g) WHERE r % 2 = 1) "
    "SELECT d.doc_id, coalesce(x, '') AS phrases FROM documents d LEFT JOIN (SELECT p.doc_id, string_agg(CASE WHEN st.i IS NOT NULL THEN p.a || '_' || p.b ELSE p.a END, ' ' ORDER BY p.i) AS x "
    "FROM p LEFT JOIN st ON st.doc_id = p.doc_id AND st.i = p.i LEFT JOIN st z ON z.doc_id = p.doc_id AND z.i = p.i - 1 WHERE z.i IS NULL GROUP BY p.doc_id) USING (doc_id)",
)
def _(spark, sf):
    df = plain(spark, sf)
    out = corpus.join_collocations(df, "doc_id", "tokens", corpus.collocations(df, "tokens", 5, 10.0))
    return out.select("doc_id", F.array_join("phrases", " ").alias("phrases"))


# ---------------------------------------------------------------- reports


@query("ag1_label_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf):
    return corpus.label_counts(documents(spark, sf), "lang")


@query("ag9_value_counts_bar", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def _(spark, sf):
    return corpus.label_counts(table(spark, sf, "labels"), "quality").orderBy("quality")


@query("ag7_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'P') AS P FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return corpus.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F", "P"])


@query("ag8_parent_share", "SELECT l_suppkey, l_returnflag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_suppkey), 4) AS percent FROM lineitem GROUP BY l_suppkey, l_returnflag")
def _(spark, sf):
    return corpus.share_of_parent(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


@query("tm15_hand_labelled_topics", "SELECT topic, quality, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY topic), 4) AS percent FROM (SELECT (['price', 'service', 'place', 'other'])[doc_id % 4 + 1] AS topic, quality FROM labels) GROUP BY topic, quality")
def _(spark, sf):
    topic = F.get(string_array(["price", "service", "place", "other"]), (col("doc_id") % 4).cast("int"))
    return corpus.share_of_parent(table(spark, sf, "labels").withColumn("topic", topic), "topic", "quality")


WC = "CASE WHEN length(trim(text)) > 0 THEN len(string_split_regex(trim(text), '\\s+')) ELSE 0 END"


@query("ag10_length_stats", f"SELECT count(*) AS n, round(avg(w), 6) AS mean, CAST(quantile_cont(w, 0.5) AS DOUBLE) AS median, round(stddev_pop(w), 6) AS std, round(CAST(quantile_cont(w, 0.01) AS DOUBLE), 6) AS p01, round(CAST(quantile_cont(w, 0.99) AS DOUBLE), 6) AS p99 FROM (SELECT CAST({WC} AS DOUBLE) AS w FROM documents)")
def _(spark, sf):
    return corpus.length_stats(documents(spark, sf), T.word_count(col("text")))


@query(
    "ag11_histogram",
    "SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1, 2",
)
def _(spark, sf):
    return corpus.histogram(table(spark, sf, "events"), "value", 40, "event_type")


@query("ag11_histogram_lineitem", "SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return corpus.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)


@query(
    "ag12_melt_and_quartiles",
    "WITH m AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME component VALUE score) "
    "SELECT l_returnflag, component, q AS prob, round(CASE q WHEN 0.25 THEN a WHEN 0.5 THEN b ELSE c END, 6) AS quantile FROM (SELECT l_returnflag, component, CAST(quantile_cont(score, 0.25) AS DOUBLE) AS a, "
    "CAST(quantile_cont(score, 0.5) AS DOUBLE) AS b, CAST(quantile_cont(score, 0.75) AS DOUBLE) AS c FROM m GROUP BY l_returnflag, component), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS q)",
)
def _(spark, sf):
    out = corpus.component_quartiles(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("quantile", F.round("quantile", 6))


@query("ag13_series_summary", "SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events")
def _(spark, sf):
    return corpus.series_summary(table(spark, sf, "events"), "value")


TOPIC_SQL = "CASE WHEN label >= 8 THEN -1 ELSE label END"


@query("ag17_topic_doc_counts", f"SELECT topic, count(*) AS doc_count, (SELECT count(*) FROM embeddings WHERE label >= 8) AS outliers, (SELECT count(DISTINCT label) FROM embeddings WHERE label < 8) AS topics FROM (SELECT {TOPIC_SQL} AS topic FROM embeddings) WHERE topic <> -1 GROUP BY topic")
def _(spark, sf):
    return corpus.topic_sizes(table(spark, sf, "embeddings").select(F.when(col("label") >= 8, -1).otherwise(col("label")).alias("topic")), "topic")


KEYWORD_ROWS = "kr AS (SELECT doc_id, term, min(i) AS first, 10.0 / (count(*) + 1) AS score FROM t GROUP BY doc_id, term)"


def keyword_rows(spark, sf):
    """Scored keywords: the more often a term occurs in its document, the lower (better) its score."""
    rows = toks(spark, sf).select("doc_id", F.posexplode("tokens").alias("i", "term"))
    return rows.groupBy("doc_id", "term").agg((F.min("i") + 1).cast("bigint").alias("first"), (F.lit(10.0) / (F.count("*") + 1)).alias("score"))


@query("so1_order_by_relevance", f"WITH {TERMS}, {KEYWORD_ROWS} SELECT doc_id, term, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score, term) AS rank FROM kr ORDER BY doc_id, score, term")
def _(spark, sf):
    from textspark.operators.keywords import order_by_relevance

    return order_by_relevance(keyword_rows(spark, sf), "doc_id").select("doc_id", "term", F.round("score", 6).alias("score"), "rank")


@query("kw4_threshold_sweep", f"WITH {TERMS}, {KEYWORD_ROWS} SELECT threshold, count(*) FILTER (score <= threshold) AS n_keywords, count(*) FILTER (score <= threshold AND contains(term, 'th')) AS n_kept FROM kr, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 2.5::DOUBLE]) AS threshold) GROUP BY threshold")
def _(spark, sf):
    rows = keyword_rows(spark, sf).withColumn("overlaps", F.contains("term", F.lit("th")))
    return corpus.threshold_sweep(rows, "score", "overlaps")


@query("jn2_zip_positions", "SELECT vec_id AS topic, ('t' || CAST(i - 1 AS VARCHAR)) AS term, round(CAST(embedding[i] AS DOUBLE), 9) AS weight FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def _(spark, sf):
    from textspark.operators.topics import zip_terms

    topics = table(spark, sf, "embeddings").select(
        col("vec_id").alias("topic"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("terms"),
        F.transform(col("embedding"), lambda x: x.cast("double")).alias("weights"),
    )
    return zip_terms(topics, "topic", "terms", "weights").withColumn("weight", F.round("weight", 9))


