"""Lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.functions import scores as SC
from textspark.functions import text as T
from textspark.operators import corpus, sentiment
from textspark.resources import values as V

from .base import documents, lit, query, spread, table
from .text_checks import NORMALISED, WORDS

col = F.col

# ---------------------------------------------------------------- lexicon of the benchmark words, valence by digest

LEX = (
    "lex AS (SELECT w AS word, (('0x' || substring(md5(w), 1, 8))::BIGINT % 9 - 4)::DOUBLE AS valence FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) "
    "WHERE ('0x' || substring(md5(w), 1, 8))::BIGINT % 9 <> 4)"
)


def lexicon(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    valence = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint"), F.lit(9)) - 4
    return words.withColumn("valence", valence.cast("double")).filter("valence <> 0")


SAID_SQL = (
    "said AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'not very ' WHEN 1 THEN 'VERY ' WHEN 2 THEN 'but ' WHEN 3 THEN 'never so ' ELSE '' END "
    "|| CASE WHEN doc_id % 3 = 0 THEN upper(left(text, 40)) || substr(text, 41) ELSE text END || CASE doc_id % 4 WHEN 0 THEN '!!' WHEN 1 THEN '???' WHEN 2 THEN ' really? why? oh?! ok????' ELSE '' END AS text FROM documents)"
)


def said(spark, sf):
    """Documents with modifiers put in front, some capitals and closing marks."""
    d, t = col("doc_id"), col("text")
    head = F.when(d % 5 == 0, "not very ").when(d % 5 == 1, "VERY ").when(d % 5 == 2, "but ").when(d % 5 == 3, "never so ").otherwise("")
    body = F.when(d % 3 == 0, F.concat(F.upper(F.substring(t, 1, 40)), F.substring(t, F.lit(41), F.length(t)))).otherwise(t)
    tail = F.when(d % 4 == 0, "!!").when(d % 4 == 1, "???").when(d % 4 == 2, " really? why? oh?! ok????").otherwise("")
    return spread(documents(spark, sf)).select("doc_id", "lang", F.concat(head, body, tail).alias("text"))


def _in(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


EDGE = "[" + "".join("\\" + c for c in V.PUNCTUATION) + "]+"


def polarity_sql(source: str, key: str, name: str = "pol") -> str:
    """CTEs ending in ``name`` (key, compound, pos, neg, neu) for the texts of ``source``."""
    up, down, neg = _in(V.BOOSTER_UP), _in(V.BOOSTER_DOWN), _in(V.NEGATIONS)
    steps = ""
    prior = "v0"
    for d, decay in zip((1, 2, 3), V.BOOST_DECAY):
        lag = lambda c: f"lag({c}, {d}) OVER o"
        steps += (
            f"{name}_v{d} AS (SELECT *, CASE WHEN coalesce(nb{d}, false) THEN -0.74 ELSE 1 END * ({prior} + CASE WHEN coalesce(bb{d}, 0) <> 0 THEN {decay} * ("
            f"CASE WHEN {prior} < 0 THEN -bb{d} ELSE bb{d} END + CASE WHEN cb{d} THEN CASE WHEN {prior} > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END) ELSE 0 END) AS v{d} FROM {name}_{'l' if d == 1 else f'v{d - 1}'}), "
        )
        prior = f"v{d}"
    lags = ", ".join(f"lag(boost, {d}) OVER o AS bb{d}, lag(neg, {d}) OVER o AS nb{d}, lag(caps, {d}) OVER o AS cb{d}" for d in (1, 2, 3))
    return f"""{name}_raw AS (SELECT {key}, i, CASE WHEN length(st) <= 2 THEN t ELSE st END AS w FROM (SELECT {key}, i, t, regexp_replace(t, {lit('^' + EDGE + '|' + EDGE + '$')}, '', 'g') AS st FROM
      (SELECT {key}, unnest({WORDS}) AS t, generate_subscripts({WORDS}, 1) AS i FROM {source}))),
    {name}_w AS (SELECT *, lower(w) AS low, w = upper(w) AND w <> lower(w) AS up, count(*) OVER (PARTITION BY {key}) AS nw,
      count(*) FILTER (w = upper(w) AND w <> lower(w)) OVER (PARTITION BY {key}) AS nu, min(CASE WHEN lower(w) = 'but' THEN i END) OVER (PARTITION BY {key}) AS but FROM {name}_raw),
    {name}_m AS (SELECT *, up AND nu < nw AS caps, CASE WHEN low IN {up} AND low NOT IN (SELECT word FROM lex) THEN 0.293 WHEN low IN {down} AND low NOT IN (SELECT word FROM lex) THEN -0.293 ELSE 0 END AS boost,
      (low IN {neg} AND low NOT IN (SELECT word FROM lex)) OR contains(low, 'n''t') AS neg FROM {name}_w),
    {name}_l AS (SELECT m.*, CASE WHEN valence IS NULL THEN NULL WHEN caps THEN valence + CASE WHEN valence > 0 THEN 0.733 ELSE -0.733 END ELSE valence END AS v0, valence, {lags}
      FROM {name}_m m LEFT JOIN lex ON word = low WINDOW o AS (PARTITION BY {key} ORDER BY i)),
    {steps}{name}_s AS (SELECT {key}, CASE WHEN valence IS NULL OR boost <> 0 THEN 0 ELSE v3 * CASE WHEN but IS NULL OR i = but THEN 1 WHEN i < but THEN 0.5 ELSE 1.5 END END AS v FROM {name}_v3),
    {name}_e AS (SELECT {key}, least(length(text) - length(replace(text, '!', '')), 4) * 0.292 + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN 0.96
      WHEN length(text) - length(replace(text, '?', '')) > 1 THEN (length(text) - length(replace(text, '?', ''))) * 0.18 ELSE 0 END AS emph FROM {source}),
    {name}_a AS (SELECT e.{key}, emph, round(coalesce(sum(v), 0), 9) AS s, round(coalesce(sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END), 0), 9) AS p, round(coalesce(sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END), 0), 9) AS n, count(*) FILTER (v = 0) AS z, count(v) AS nw
      FROM {name}_e e LEFT JOIN {name}_s s USING ({key}) GROUP BY e.{key}, emph),
    {name}_f AS (SELECT {key}, nw, z, s + CASE WHEN s > 0 THEN emph WHEN s < 0 THEN -emph ELSE 0 END AS s, p + CASE WHEN p > abs(n) THEN emph ELSE 0 END AS p, abs(n - CASE WHEN p < abs(n) THEN emph ELSE 0 END) AS n FROM {name}_a),
    {name} AS (SELECT {key}, CASE WHEN nw > 0 THEN round(s / sqrt(s * s + 15), 4) ELSE 0 END AS compound, CASE WHEN nw > 0 THEN round(p / (p + n + z), 3) ELSE 0 END AS pos,
      CASE WHEN nw > 0 THEN round(n / (p + n + z), 3) ELSE 0 END AS neg, CASE WHEN nw > 0 THEN round(z / (p + n + z), 3) ELSE 0 END AS neu FROM {name}_f)"""


POL = f"WITH {LEX}, {SAID_SQL}, {polarity_sql('said', 'doc_id')}"
LABEL_SQL = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"


def scored(spark, sf):
    return sentiment.labelled_polarity(said(spark, sf), "doc_id", "text", lexicon(spark, sf))


@query("sn1_lexicon_polarity", f"{POL} SELECT doc_id, compound, pos, neg, neu FROM pol")
def _(spark, sf):
    return scored(spark, sf).drop("label")


@query("sn2_polarity_label", f"{POL} SELECT doc_id, {LABEL_SQL} AS label FROM pol")
def _(spark, sf):
    return scored(spark, sf).select("doc_id", "label")


@query("sn3_any_positive_label", f"{POL} SELECT CAST(CASE WHEN pos > 0 THEN 1 ELSE 0 END AS BIGINT) AS label, count(*) AS n FROM pol GROUP BY 1")
def _(spark, sf):
    return scored(spark, sf).groupBy(SC.any_positive(col("pos")).cast("bigint").alias("label")).agg(F.count("*").alias("n"))


PATTERN_LEX = f"{LEX}, pl AS (SELECT word, valence / 4 AS polarity, length(word) / 20.0 AS subjectivity FROM lex)"


@query(
    "sn4_polarity_subjectivity",
    rf"WITH {PATTERN_LEX}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS word FROM documents), a AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM w JOIN pl USING (word) GROUP BY doc_id) "
    "SELECT doc_id, round(coalesce(p, 0), 6) AS polarity, round(CAST(coalesce(s, 0) AS DOUBLE), 6) AS subjectivity, CASE WHEN coalesce(p, 0) > 0.2 THEN 'positive' ELSE 'negative' END AS label FROM documents LEFT JOIN a USING (doc_id)",
)
def _(spark, sf):
    lex = lexicon(spark, sf).select("word", (col("valence") / 4).alias("polarity"), (F.length("word") / F.lit(20.0)).alias("subjectivity"))
    out = sentiment.pattern_sentiment(spread(documents(spark, sf)), "doc_id", "text", lex)
    return out.withColumns({c: F.round(c, 6) for c in ("polarity", "subjectivity")})


SENTENCE_SQL = (
    f"WITH {LEX}, sn AS (SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sentence, unnest(ss) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)), "
    f"w AS (SELECT doc_id, sentence, unnest({NORMALISED}) AS word FROM sn), l AS (SELECT doc_id, sentence, CASE WHEN sum(sign(valence)) >= 0 THEN 'positive' ELSE 'negative' END AS label FROM w JOIN lex USING (word) GROUP BY doc_id, sentence)"
)


def dictionary(spark, sf):
    return lexicon(spark, sf).select("word", F.when(col("valence") > 0, "positive").otherwise("negative").alias("label"))


@query("sn5_dictionary_sentiment", f"{SENTENCE_SQL} SELECT d.doc_id, coalesce(f, 'na') AS sentiment FROM documents d LEFT JOIN (SELECT doc_id, arg_min(label, sentence) AS f FROM l GROUP BY doc_id) USING (doc_id)")
def _(spark, sf):
    return sentiment.dictionary_sentiment(spread(documents(spark, sf)), "doc_id", "text", dictionary(spark, sf))


@query("sn5_sentence_sentiment", f"{SENTENCE_SQL} SELECT doc_id, CAST(sentence AS BIGINT) AS sentence, label FROM l")
def _(spark, sf):
    out = sentiment.sentence_sentiment(spread(documents(spark, sf)), "doc_id", "text", dictionary(spark, sf))
    return out.withColumn("sentence", col("sentence").cast("bigint"))


@query(
    "sn6_per_word_scores",
    f"WITH {LEX}, src AS (SELECT doc_id, text FROM documents), {polarity_sql('src', 'doc_id')}, ws AS (SELECT doc_id, i - 1 AS i, lower(regexp_replace(t, {lit('^' + EDGE + '|' + EDGE + '$')}, '', 'g')) AS word FROM (SELECT doc_id, unnest({WORDS}) AS t, generate_subscripts({WORDS}, 1) AS i FROM src)) "
    "SELECT doc_id, -1 AS i, '' AS word, compound AS score FROM pol UNION ALL SELECT doc_id, i, ws.word, round(coalesce(valence / sqrt(valence * valence + 15), 0), 4) FROM ws LEFT JOIN lex ON lex.word = ws.word",
)
def _(spark, sf):
    out = sentiment.sentence_and_word_rows(spread(documents(spark, sf)), "doc_id", "text", lexicon(spark, sf))
    return out.select("doc_id", col("i").cast("bigint").alias("i"), F.coalesce("word", F.lit("")).alias("word"), "score")


TWO_SQL = f"WITH {LEX}, a_src AS (SELECT doc_id, text FROM documents), b_src AS (SELECT doc_id, 'VERY ' || text || '!' AS text FROM documents), {polarity_sql('a_src', 'doc_id', 'pa')}, {polarity_sql('b_src', 'doc_id', 'pb')}"


def two_columns(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", col("text").alias("a"), F.concat(F.lit("VERY "), col("text"), F.lit("!")).alias("b"))


_NAMES = ("compound", "pos", "neg", "neu")


@query(
    "sn13_multi_column_sentiment",
    TWO_SQL + " SELECT doc_id, " + ", ".join(f"p{c}.{n} AS {c}_{n}" for c in "ab" for n in _NAMES)
    + ", " + ", ".join(f"{LABEL_SQL.replace('compound', f'p{c}.compound')} AS {c}_label" for c in "ab") + " FROM pa JOIN pb USING (doc_id)",
)
def _(spark, sf):
    return sentiment.sentiment_columns(two_columns(spark, sf), "doc_id", ["a", "b"], lexicon(spark, sf))


@query(
    "sn13_columns_with_sentences_and_tokens",
    f"{SENTENCE_SQL}, src AS (SELECT doc_id, text FROM documents), {polarity_sql('src', 'doc_id')}, s AS (SELECT doc_id, string_agg(label, ' ' ORDER BY sentence) AS labels, arg_min(label, sentence) AS first FROM l GROUP BY doc_id) "
    f"SELECT d.doc_id, d.lang, d.source, d.text AS a, compound AS a_compound, {LABEL_SQL} AS a_label, coalesce(labels, '') AS a_sentence_labels, coalesce(first, 'na') AS a_sentiment, array_to_string({NORMALISED}, ' ') AS a_tokens, 'na' AS b_sentiment "
    "FROM documents d JOIN pol USING (doc_id) LEFT JOIN s USING (doc_id)",
)
def _(spark, sf):
    """A text column with everything that is found in it, and one without a known word."""
    rows = spread(documents(spark, sf)).select("doc_id", "lang", "source", col("text").alias("a"), F.lit("7 8 9").alias("b"))
    out = sentiment.sentiment_table(rows, "doc_id", ["a", "b"], lexicon(spark, sf), dictionary(spark, sf))
    joined = lambda c: F.array_join(c, " ").alias(c)
    return out.select("doc_id", "lang", "source", "a", "a_compound", "a_label", joined("a_sentence_labels"), "a_sentiment", joined("a_tokens"), "b_sentiment")


@query("jn1_attach_column_results", TWO_SQL + " SELECT doc_id, lang, pa.compound AS a_compound, pb.compound AS b_compound FROM documents LEFT JOIN pa USING (doc_id) LEFT JOIN pb USING (doc_id)")
def _(spark, sf):
    wide = sentiment.sentiment_columns(two_columns(spark, sf), "doc_id", ["a", "b"], lexicon(spark, sf))
    return documents(spark, sf).select("doc_id", "lang").join(wide.select("doc_id", "a_compound", "b_compound"), "doc_id", "left")


@query(
    "sn14_distribution_by_label",
    f"{POL}, l AS (SELECT *, {LABEL_SQL} AS label FROM pol), d AS (SELECT label, lang, compound FROM l JOIN documents USING (doc_id)) "
    "SELECT label, 'count' AS report, '' AS item, count(*)::DOUBLE AS value FROM l GROUP BY label UNION ALL SELECT label, 'lang', lang, count(*)::DOUBLE FROM d GROUP BY label, lang "
    "UNION ALL SELECT label, 'bin', CAST(CAST(least(floor((compound - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS VARCHAR), count(*)::DOUBLE FROM l, (SELECT min(compound) AS lo, max(compound) AS hi FROM l) GROUP BY 1, 3 "
    "UNION ALL SELECT label, 'median', 'pos', round(CAST(quantile_cont(pos, 0.5) AS DOUBLE), 6) FROM l GROUP BY label",
)
def _(spark, sf):
    s = scored(spark, sf).join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    s = s.persist()  # four reports read the same scores
    counts = corpus.label_counts(s, "label").select("label", F.lit("count").alias("report"), F.lit("").alias("item"), col("n").cast("double").alias("value"))
    langs = s.groupBy("label", "lang").agg(F.count("*").alias("n")).select("label", F.lit("lang").alias("report"), col("lang").alias("item"), col("n").cast("double").alias("value"))
    bins = corpus.histogram(s, "compound", 40, "label").select("label", F.lit("bin").alias("report"), col("bin").cast("string").alias("item"), col("n").cast("double").alias("value"))
    q = corpus.component_quartiles(s, "label", ["pos"]).filter(col("prob") == 0.5)
    medians = q.select("label", F.lit("median").alias("report"), col("component").alias("item"), F.round("quantile", 6).alias("value"))
    return counts.unionAll(langs).unionAll(bins).unionAll(medians)


WORD_LABELS = f"WITH {LEX}, w AS (SELECT doc_id, unnest({NORMALISED}) AS word, generate_subscripts({NORMALISED}, 1) AS i FROM documents), g AS (SELECT doc_id, i, word, coalesce(valence / sqrt(valence * valence + 15), 0) AS compound FROM w LEFT JOIN lex USING (word))"


@query("ag14_per_label_word_lists", f"{WORD_LABELS} SELECT doc_id, {LABEL_SQL} AS label, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM g GROUP BY 1, 2")
def _(spark, sf):
    out = sentiment.word_distribution(spread(documents(spark, sf)), "doc_id", "text", lexicon(spark, sf))
    return out.select("doc_id", "label", "n", F.array_join("words", " ").alias("words"))




@query(
    "sn15_word_distribution",
    f"WITH {LEX}, w AS (SELECT doc_id, regexp_replace(w, '(?:ing|ed|s)$', '') AS word FROM (SELECT doc_id, unnest({NORMALISED}) AS w FROM documents)), "
    "g AS (SELECT doc_id, CASE WHEN valence IS NULL THEN '3 stars' WHEN valence >= 3 THEN '5 stars' WHEN valence > 0 THEN '4 stars' WHEN valence > -3 THEN '2 stars' ELSE '1 star' END AS stars FROM w LEFT JOIN lex USING (word)) "
    "SELECT CASE WHEN stars IN ('1 star', '2 stars') THEN 'negative' WHEN stars IN ('4 stars', '5 stars') THEN 'positive' ELSE 'neutral' END AS bucket, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1",
)
def _(spark, sf):
    from textspark.operators.scale import lookup

    lemmas = F.transform(T.normalise_tokens(T.tokens(col("text"))), lambda w: F.regexp_replace(w, r"(?:ing|ed|s)$", ""))
    rows = spread(documents(spark, sf)).select("doc_id", F.explode(lemmas).alias("word"))
    v = col("valence")
    stars = F.when(v.isNull(), "3 stars").when(v >= 3, "5 stars").when(v > 0, "4 stars").when(v > -3, "2 stars").otherwise("1 star")
    bucket = SC.star_bucket(stars).alias("bucket")
    per_doc = lookup(rows, lexicon(spark, sf), ["word"], col("doc_id")).groupBy(bucket, "doc_id").agg(F.count("*").alias("m"))
    return per_doc.groupBy("bucket").agg(F.sum("m").alias("n"), F.count("*").alias("docs"))


RECORDS_SQL = "rec AS (SELECT conv_id * 1000 + turn AS k, CASE WHEN conv_id % 11 <> 0 THEN role END AS pid, CASE WHEN turn % 4 <> 3 THEN text ELSE ' ' END AS text FROM conversations), good AS (SELECT k, pid, text FROM rec WHERE pid IS NOT NULL AND trim(text) <> '')"


def records(spark, sf):
    return spread(table(spark, sf, "conversations")).select(
        (col("conv_id") * 1000 + col("turn")).alias("k"), F.when(col("conv_id") % 11 != 0, col("role")).alias("pid"), F.when(col("turn") % 4 != 3, col("text")).otherwise(" ").alias("text")
    )


@query(
    "sn16_record_sentiment",
    f"WITH {LEX}, {RECORDS_SQL}, {polarity_sql('good', 'k')} SELECT k, pid, {LABEL_SQL} AS label, compound, left(text, 50) || '...' AS preview, 'none' AS error FROM good JOIN pol USING (k) "
    "UNION ALL SELECT k, coalesce(pid, ''), '', 0, '', CASE WHEN pid IS NULL THEN 'record without id' ELSE 'empty text' END FROM rec WHERE pid IS NULL OR trim(text) = ''",
)
def _(spark, sf):
    ok, err = sentiment.sentiment_records(records(spark, sf), "k", "pid", "text", lexicon(spark, sf))
    a = ok.select("k", "pid", "label", "compound", col("text_preview").alias("preview"), F.lit("none").alias("error"))
    empty = F.lit("")
    return a.unionAll(err.select("k", F.coalesce("pid", empty), empty, F.lit(0.0), empty, "error"))


@query(
    "jn5_merge_pii_and_sentiment",
    f"WITH {LEX}, {RECORDS_SQL}, {polarity_sql('good', 'k')} SELECT k, {LABEL_SQL} AS label, compound, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*[.][A-Za-z]{{2,}}', '[EMAIL_ADDRESS]', 'g') AS redacted, "
    "CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*[.][A-Za-z]{2,}')) AS BIGINT) AS n_entities FROM good JOIN pol USING (k)",
)
def _(spark, sf):
    from textspark.plans.jobs import analyse_records

    ok, _errors = analyse_records(records(spark, sf), "k", "pid", "text", lexicon(spark, sf), ["EMAIL_ADDRESS"])
    return ok.select("k", "label", "compound", col("redacted_text").alias("redacted"), col("pii_entity_count").cast("bigint").alias("n_entities"))


