"""Keyword extraction, topic models and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.functions import text as T
from textspark.operators import classify, density, keywords, topics
from textspark.operators.scale import checkpointed
from textspark.resources import values as V

from .base import documents, query, spread, table
from .corpus_checks import TERMS, toks
from .text_checks import STOPS

col = F.col


# ---------------------------------------------------------------- keywords


def yake_sql(source: str, key: str, top: int = 30) -> str:
    """CTEs ending in yk (key, keyword, score, rank) by the published formulas."""
    left, right = ([f"lag(low, {d})" for d in (1, 2, 3)], [f"lead(low, {d})" for d in (1, 2, 3)])
    near = lambda side: ", ".join(f"{x} OVER o" for x in side)
    return rf"""sn AS (SELECT {key}, generate_subscripts(ss, 1) - 1 AS sentence, unnest(ss) AS text FROM
      (SELECT {key}, string_split(regexp_replace(regexp_replace(text, '^\s+', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM {source})),
    w AS (SELECT {key}, sentence, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), 1) AS i FROM sn),
    l AS (SELECT *, lower(w) AS low FROM w),
    c AS (SELECT *, [{near(left)}] AS lf, [{near(right)}] AS rt FROM l WINDOW o AS (PARTITION BY {key}, sentence ORDER BY i)),
    lp AS (SELECT {key}, low, count(x) AS n, count(DISTINCT x) AS d FROM (SELECT {key}, low, unnest(lf) AS x FROM c) WHERE x IS NOT NULL GROUP BY {key}, low),
    rp AS (SELECT {key}, low, count(x) AS n, count(DISTINCT x) AS d FROM (SELECT {key}, low, unnest(rt) AS x FROM c) WHERE x IS NOT NULL GROUP BY {key}, low),
    f AS (SELECT {key}, low, count(*) AS tf, count(*) FILTER (regexp_matches(w, '^\p{{Lu}}') AND i > 1) AS up, count(*) FILTER (w = upper(w) AND w <> lower(w) AND length(w) > 1) AS ac,
      count(DISTINCT sentence) AS sf, quantile_cont(sentence::DOUBLE, 0.5) AS med, max(sentence) AS last FROM l GROUP BY {key}, low),
    g AS (SELECT *, low NOT IN {STOPS} AND length(low) > 2 AND NOT regexp_matches(low, '^[0-9]') AS ok FROM f),
    h AS (SELECT *, avg(CASE WHEN ok THEN tf END) OVER d AS mean, stddev_pop(CASE WHEN ok THEN tf END) OVER d AS sd, max(tf) OVER d AS top, max(last) OVER d + 1 AS ns FROM g WINDOW d AS (PARTITION BY {key})),
    k AS (SELECT h.{key}, h.low, greatest(up, ac) / (1 + ln(tf)) AS c, ln(ln(3.0 + med)) AS p, tf / (coalesce(mean, 0) + coalesce(sd, 0)) AS fr,
      1 + (coalesce(lp.d / lp.n::DOUBLE, 0) + coalesce(rp.d / rp.n::DOUBLE, 0)) * tf / top AS rel, sf / ns::DOUBLE AS s
      FROM h LEFT JOIN lp ON lp.{key} = h.{key} AND lp.low = h.low LEFT JOIN rp ON rp.{key} = h.{key} AND rp.low = h.low WHERE ok),
    wt AS (SELECT {key}, low, rel * p / (c + fr / rel + s / rel) AS wt FROM k),
    t AS (SELECT l.{key}, l.sentence, l.i, l.low, wt FROM l LEFT JOIN wt ON wt.{key} = l.{key} AND wt.low = l.low),
    z AS (SELECT *, lead(low) OVER o AS l2, lead(low, 2) OVER o AS l3, lead(wt) OVER o AS w2, lead(wt, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY {key}, sentence ORDER BY i)),
    cand AS (SELECT {key}, low AS keyword, wt AS pr, wt AS su FROM z WHERE wt IS NOT NULL UNION ALL SELECT {key}, low || ' ' || l2, wt * w2, wt + w2 FROM z WHERE wt * w2 IS NOT NULL
      UNION ALL SELECT {key}, low || ' ' || l2 || ' ' || l3, wt * w2 * w3, wt + w2 + w3 FROM z WHERE wt * w2 * w3 IS NOT NULL),
    sc AS (SELECT {key}, keyword, round(max(pr) / (count(*) * (1 + max(su))), 9) AS score FROM cand GROUP BY {key}, keyword),
    yk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score, keyword) AS rank FROM sc WHERE score <= 1.5) WHERE rank <= {top})"""


@query("kw1_yake_keywords", f"WITH {yake_sql('documents', 'doc_id')} SELECT doc_id, keyword, round(score, 6) AS score, rank FROM yk")
def _(spark, sf):
    return keywords.yake(spread(documents(spark, sf)), "doc_id", "text").select(
        "doc_id", "keyword", F.round("score", 6).alias("score"), col("rank").cast("bigint").alias("rank")
    )


BOTH_SQL = "src AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000000 + doc_id, text FROM documents)"


@query("kw2_keyword_rows", f"WITH {BOTH_SQL}, {yake_sql('src', 'item_id')} SELECT item_id, keyword, round(score, 6) AS score FROM yk")
def _(spark, sf):
    both = table(spark, sf, "benchmark").select("item_id", "text").unionAll(documents(spark, sf).select((col("doc_id") + 1000000000).alias("item_id"), "text"))
    return keywords.keyword_rows(both, "item_id", "text").select("item_id", "keyword", F.round("score", 6).alias("score"))


TWO_TEXTS = (
    "src AS (SELECT (conv_id * 1000 + turn) || ':a' AS id, text FROM conversations UNION ALL SELECT (conv_id * 1000 + turn) || ':b', 'Extra Keyword here. ' || text FROM conversations)"
)


@query(
    "kw3_keywords_per_column",
    f"WITH {TWO_TEXTS}, {yake_sql('src', 'id', 5)}, a AS (SELECT id, string_agg(keyword, '; ' ORDER BY rank) AS kw FROM yk GROUP BY id) "
    "SELECT conv_id * 1000 + turn AS k, coalesce(x.kw, '') AS text_keywords, coalesce(y.kw, '') AS more_keywords FROM conversations "
    "LEFT JOIN a x ON x.id = (conv_id * 1000 + turn) || ':a' LEFT JOIN a y ON y.id = (conv_id * 1000 + turn) || ':b'",
)
def _(spark, sf):
    df = table(spark, sf, "conversations").select(
        (col("conv_id") * 1000 + col("turn")).alias("k"), "text", F.concat(F.lit("Extra Keyword here. "), "text").alias("more")
    )
    out = keywords.keywords_per_column(df, "k", {"text": "text_keywords", "more": "more_keywords"}, top=5)
    return out.select("k", F.array_join("text_keywords", "; ").alias("text_keywords"), F.array_join("more_keywords", "; ").alias("more_keywords"))


# ---------------------------------------------------------------- topic models


def vectors(spark, sf):
    frame = spread(documents(spark, sf)).select("doc_id", "text", T.content_tokens(col("text")).alias("tokens"))
    return topics.term_vectors(frame, "tokens", "doc_id")


_FITTED: dict = {}  # models are tables in the shared folder; queries on one model share them


def fitted(spark, sf, online=False):
    key = (spark.sparkContext.applicationId, sf, online)
    if key not in _FITTED:
        v = _FITTED.get(("v", *key[:2])) or vectors(spark, sf)
        _FITTED["v", *key[:2]] = v
        _FITTED[key] = topics.lda(v, k=5, iterations=4, online=online), v
    return _FITTED[key]


@query("tm1_lda_topics")
def _(spark, sf):
    model, _v = fitted(spark, sf)
    return topics.topic_cloud(model).groupBy("topic").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("top_weight"))


@query("tm2_topic_words")
def _(spark, sf):
    return topics.topic_words(fitted(spark, sf)[0]).select("topic", F.array_join("topicWords", " ").alias("words"))


@query("tm3_topic_cloud")
def _(spark, sf):
    return topics.topic_cloud(fitted(spark, sf, True)[0])


@query("tm4_assign_topic")
def _(spark, sf):
    return topics.assign_topic(*fitted(spark, sf)).select("doc_id", "topicNo", F.round("probability", 6).alias("probability"))


@query("tm5_topic_scores")
def _(spark, sf):
    out = topics.topic_scores(*fitted(spark, sf), "text")
    return out.select(F.md5("reviewText").alias("text_md5"), "topicNo", "wordCount")


@query("tm6_lsi_topics")
def _(spark, sf):
    best, docs = topics.lsi(toks(spark, sf), "doc_id", "tokens", 5)
    sizes = docs.groupBy("topic").agg(F.count("*").alias("doc_count"))
    return best.join(F.broadcast(sizes), "topic", "left").select("topic", "term", F.round("score", 6).alias("score"), "rank", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


@query("tm7_nmf_topics")
def _(spark, sf):
    best, docs = topics.nmf(toks(spark, sf), "doc_id", "tokens", k=5, iterations=5)
    sizes = docs.groupBy("topic").agg(F.count("*").alias("doc_count"))
    return best.join(F.broadcast(sizes), "topic", "left").select("topic", "term", F.round("score", 6).alias("score"), "rank", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def auto_fitted(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "auto")
    if key not in _FITTED:
        model, sizes = topics.auto_topics(fitted(spark, sf)[1], iterations=4, gain=0.1)
        _FITTED[key] = model, checkpointed(sizes)
    return _FITTED[key]


@query("tm8_auto_k_topics")
def _(spark, sf):
    return auto_fitted(spark, sf)[1]


@query("tm9_embedding_topics")
def _(spark, sf):
    return topics.embedding_topics(table(spark, sf, "embeddings"), "vec_id", "embedding", k=10)


SPREAD_SQL = "p AS (SELECT vec_id, label * 0.6::DOUBLE + CAST(embedding[1] AS DOUBLE) AS x, label % 3 * 0.8::DOUBLE + CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


@query(
    "tm9_density_topics",
    f"""WITH RECURSIVE {SPREAD_SQL},
    near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a, p b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.15),
    core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    named AS (SELECT a AS vec_id, min(b) AS cluster FROM reach GROUP BY a),
    every AS (SELECT * FROM named UNION ALL SELECT n.a, min(m.cluster) FROM near n JOIN named m ON m.vec_id = n.b WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a),
    sizes AS (SELECT cluster, row_number() OVER (ORDER BY count(*) DESC, cluster) - 1 AS topic FROM every GROUP BY cluster HAVING count(*) >= 2)
    SELECT p.vec_id, CAST(coalesce(topic, -1) AS BIGINT) AS topic FROM p LEFT JOIN every USING (vec_id) LEFT JOIN sizes USING (cluster)""",
)
def _(spark, sf):
    """Three coordinates of each embedding, parted by its label: groups of several densities, and outliers."""
    e = lambda i: F.get("embedding", i).cast("double")
    v = F.array(col("label") * F.lit(0.6) + e(0), col("label") % 3 * F.lit(0.8) + e(1), e(2))
    points = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return density.density_topics(points, "vec_id", "v", 0.15, 5).select("vec_id", col("topic").cast("bigint").alias("topic"))


def labelled(spark, sf):
    """Documents with the label of the embedding of the same number as topic; labels from 8 up and documents without one are outliers."""
    emb = table(spark, sf, "embeddings").select(col("vec_id").alias("doc_id"), F.when(col("label") >= 8, -1).otherwise(col("label")).alias("topic"))
    return toks(spark, sf).join(emb, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))


LABELLED = f"{TERMS}, e AS (SELECT vec_id AS doc_id, CASE WHEN label >= 8 THEN -1 ELSE label END AS topic FROM embeddings), x AS (SELECT topic, term FROM t JOIN e USING (doc_id) WHERE topic <> -1), c AS (SELECT topic, term, count(*) AS n FROM x GROUP BY topic, term), f AS (SELECT term, sum(n) AS f FROM c GROUP BY term)"
INFO = (
    f"{LABELLED}, w AS (SELECT topic, term, n * ln(1 + (SELECT sum(n) * 1.0 / count(DISTINCT topic) FROM c) / f) AS weight FROM c JOIN f USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM w), "
    "k AS (SELECT topic, string_agg(term, ' ' ORDER BY rank) AS keywords, string_agg(CASE WHEN rank <= 5 THEN term END, ' ' ORDER BY rank) AS five, round(max(weight), 6) AS best FROM r WHERE rank <= 10 GROUP BY topic), "
    "de AS (SELECT d.doc_id, coalesce(e.topic, -1) AS topic FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id)"
)


@query("tm11_topic_info", f"WITH {INFO} SELECT topic, keywords, best, count(*) AS doc_count, (SELECT count(*) FROM de WHERE topic = -1) AS outliers FROM de LEFT JOIN k USING (topic) WHERE topic <> -1 GROUP BY ALL")
def _(spark, sf):
    info = topics.topic_info(labelled(spark, sf), "topic", "tokens")
    return info.select("topic", F.array_join("keywords", " ").alias("keywords"), F.round(F.get("scores", 0), 6).alias("best"), "doc_count", "outliers")


@query("jn6_label_vs_document_join", f"WITH {INFO} SELECT doc_id, de.topic, coalesce(five, '') AS topic_keywords FROM de LEFT JOIN k ON k.topic = de.topic")
def _(spark, sf):
    docs = labelled(spark, sf)
    out = topics.doc_topics(docs.select("doc_id", "topic"), topics.topic_info(docs, "topic", "tokens"), "topic")
    return out.select("doc_id", "topic", F.array_join("topic_keywords", " ").alias("topic_keywords"))


@query(
    "tm12_topic_similarity",
    "WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) "
    "SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS cosine FROM m a JOIN m b USING (i) GROUP BY a.label, b.label",
)
def _(spark, sf):
    c = topics.centroids(table(spark, sf, "embeddings"), "label", "embedding", 64)
    return topics.topic_similarity(c, "label").withColumn("cosine", F.round("cosine", 6))


@query("tm13_topic_map_2d")
def _(spark, sf):
    c = topics.centroids(table(spark, sf, "embeddings"), "label", "embedding", 64)
    return topics.topic_map(c, "label")


@query(
    "tm14_topic_term_relevance",
    f"WITH {LABELLED}, p AS (SELECT c.topic, c.term, c.n, c.n / (sum(c.n) OVER (PARTITION BY c.topic))::DOUBLE AS pt, f.f / (SELECT sum(n) FROM c)::DOUBLE AS p, (sum(c.n) OVER (PARTITION BY c.topic)) / (SELECT sum(n) FROM c)::DOUBLE AS prevalence FROM c JOIN f USING (term)) "
    "SELECT topic, term, n, round(pt, 9) AS p_term_topic, round(p, 9) AS p_term, round(prevalence, 9) AS prevalence, round(0.6 * ln(pt) + 0.4 * ln(pt / p), 6) AS relevance FROM p",
)
def _(spark, sf):
    out = topics.topic_relevance(labelled(spark, sf).filter("topic <> -1"), "topic", "tokens")
    return out.withColumns({c: F.round(c, 9) for c in ("p_term_topic", "p_term", "prevalence")}).withColumn("relevance", F.round("relevance", 6))


# ---------------------------------------------------------------- classifiers


def labelled_texts(spark, sf):
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", T.content_tokens(col("text")).alias("tokens"), col("quality").cast("double").alias("label")
    )


def all_texts(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", T.content_tokens(col("text")).alias("tokens"))


NB_SQL = f"""WITH {TERMS}, tr AS (SELECT doc_id, quality AS label FROM labels JOIN documents USING (doc_id)), c AS (SELECT label, term, count(*) AS n FROM t JOIN tr USING (doc_id) GROUP BY label, term),
    v AS (SELECT DISTINCT term FROM c), l AS (SELECT label, ln((count(*) + 1.0) / ((SELECT count(*) FROM tr) + (SELECT count(DISTINCT label) FROM tr))) AS prior FROM tr GROUP BY label),
    z AS (SELECT label, sum(n) + (SELECT count(*) FROM v) AS total FROM c GROUP BY label),
    w AS (SELECT l.label, v.term, ln((coalesce(n, 0) + 1.0) / total) AS w FROM l CROSS JOIN v JOIN z ON z.label = l.label LEFT JOIN c ON c.label = l.label AND c.term = v.term),
    s AS (SELECT d.doc_id, l.label, prior + coalesce(x.s, 0) AS s FROM documents d CROSS JOIN l LEFT JOIN (SELECT doc_id, label, sum(w) AS s FROM t JOIN w USING (term) GROUP BY doc_id, label) x ON x.doc_id = d.doc_id AND x.label = l.label),
    p AS (SELECT doc_id, max(CASE WHEN label = 0 THEN s END) AS s0, max(CASE WHEN label = 1 THEN s END) AS s1 FROM s GROUP BY doc_id)
    SELECT doc_id, CASE WHEN s1 > s0 THEN '{V.LABEL_SETS["binary"][1]}' ELSE '{V.LABEL_SETS["binary"][0]}' END AS label, round(1 / (1 + exp(least(s0 - s1, 700))), 6) AS positive FROM p"""


@query("sn7_naive_bayes_sentiment", NB_SQL)
def _(spark, sf):
    model = classify.train_naive_bayes(labelled_texts(spark, sf), "tokens", "label")
    out = classify.predict_naive_bayes(model, all_texts(spark, sf), "doc_id", "tokens", V.LABEL_SETS["binary"])
    return out.select("doc_id", "label", F.round(F.get("probabilities", 1), 6).alias("positive"))


def split(df):
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    return df.filter(part != 0), df.filter(part == 0)


@query("sn8_mean_embedding_classifier")
def _(spark, sf):
    train, validation = split(labelled_texts(spark, sf))
    _model, scores = classify.train_text_classifier(train, validation, "tokens", "label", size=50, epochs=2)
    return train.agg(F.count("*").alias("n_train"), F.lit(scores["train_accuracy"]).alias("train_accuracy"), F.lit(scores["validation_accuracy"]).alias("validation_accuracy"))


@query("sn9_predict_labels")
def _(spark, sf):
    train, validation = split(labelled_texts(spark, sf))
    model, _scores = classify.train_text_classifier(train, validation, "tokens", "label", size=16, epochs=1, reg=(0.01,))
    return classify.predict(model, all_texts(spark, sf), ["doc_id"]).select("doc_id", "prediction")


def _length_scorer():
    """A stand-in per-text model: the share of short words decides."""
    import pandas as pd

    def score(texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("###").any():
            raise ValueError("junk text")
        short = texts.str.split().map(lambda ws: sum(len(w) < 4 for w in ws) / max(len(ws), 1))
        return pd.DataFrame({"NEGATIVE": 1 - short.to_numpy(), "POSITIVE": short.to_numpy()})

    return score


SCORED_SQL = (
    "SELECT doc_id, CASE WHEN contains(text, '###') THEN 'error' WHEN s > 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label FROM "
    "(SELECT doc_id, text, len(list_filter(ws, lambda w: length(w) < 4)) / greatest(len(ws), 1)::DOUBLE AS s FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM documents))"
)


@query("sn10_score_with_model", SCORED_SQL.replace("SELECT doc_id, CASE", "SELECT label, count(*) AS n FROM (SELECT doc_id, CASE") + ") GROUP BY label")
def _(spark, sf):
    out = classify.score_with_model(spread(documents(spark, sf)), "doc_id", "text", _length_scorer, V.LABEL_SETS["binary"])
    return out.groupBy("label").agg(F.count("*").alias("n"))


@query("sn12_classify_safe", SCORED_SQL)
def _(spark, sf):
    out = classify.score_with_model(spread(documents(spark, sf)), "doc_id", "text", _length_scorer, V.LABEL_SETS["binary"])
    return out.select("doc_id", "label")


