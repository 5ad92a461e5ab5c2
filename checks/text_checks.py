"""Reading, filtering, cleaning, tokenising."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.functions import masks as M
from textspark.functions import scores as SC
from textspark.functions import text as T
from textspark.functions.expr import string_array
from textspark.operators import filters, language
from textspark.resources import values as V
from textspark.sources import readers

from .base import documents, lit, query, spread, table

STOPS = "(" + ", ".join(lit(w) for w in V.STOP_WORDS) + ")"
WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
col = F.col


# ---------------------------------------------------------------- sources


@query("io1_read_parquet_dir", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def _(spark, sf):
    docs = readers.read_docs(spark, f"{sf}/documents.parquet")  # a file, or a folder of files
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "io6_csv_row_to_doc",
    "SELECT n_nationkey, trim(concat_ws(' ', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS text FROM nation "
    "UNION ALL SELECT s_suppkey, trim(concat_ws(' ', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR))) FROM supplier",
)
def _(spark, sf):
    a = readers.rows_as_docs(table(spark, sf, "nation")).select("n_nationkey", "text")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return a.withColumn("n_nationkey", col("n_nationkey").cast("bigint")).unionAll(readers.rows_as_docs(s).select("s_suppkey", "text"))


@query(
    "io7_read_labelled_lines",
    f"SELECT CAST(doc_id % 2 AS BIGINT) AS label, count(*) AS n, CAST(sum(len({WORDS})) AS BIGINT) AS n_tokens, "
    f"CAST(max(len({WORDS})) AS BIGINT) AS max_length FROM documents GROUP BY doc_id % 2",
)
def _(spark, sf):
    lines = documents(spark, sf).select(F.concat_ws(" ", (col("doc_id") % 2).cast("string"), F.regexp_replace("text", r"^\s+", "")).alias("value"))
    parsed = readers.labelled(lines)
    return parsed.groupBy(col("label").cast("bigint").alias("label")).agg(
        F.count("*").alias("n"),
        F.sum(F.size(F.filter("tokens", lambda w: w != ""))).alias("n_tokens"),
        F.max(F.size(F.filter("tokens", lambda w: w != ""))).cast("bigint").alias("max_length"),
    )


@query("io8_read_record_batch", "SELECT conv_id, CAST(turn AS BIGINT) AS position, role AS patient_id, text FROM conversations")
def _(spark, sf):
    request = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.to_json(F.struct(F.array(F.struct(col("role").alias("patient_id"), "text")).alias("data"))).alias("inner"),
    )
    payload = F.when(col("conv_id") % 2 == 0, col("inner")).otherwise(F.to_json(F.struct(col("inner").alias("body"))))
    return readers.records_of(request.select("conv_id", "turn", payload.alias("payload")), "payload").select(
        "conv_id", col("turn").alias("position"), "patient_id", "text"
    )


@query(
    "io9_survey_header_canonicalise",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer",
)
def _(spark, sf):
    raw = table(spark, sf, "customer").select(
        col("c_custkey").alias(" Customer Id "), col("c_name").alias("name "), F.when(col("c_custkey") % 7 != 0, col("c_mktsegment")).alias("segment")
    )
    return readers.canonicalise(raw, {"Customer Id": "id"})


@query(
    "io17_explode_arrays_zip",
    f"SELECT doc_id, CAST(i AS BIGINT) AS begin, w AS chunk, CAST(length(w) AS BIGINT) AS n FROM (SELECT doc_id, unnest({WORDS}) AS w, "
    f"generate_subscripts({WORDS}, 1) AS i FROM documents)",
)
def _(spark, sf):
    docs = documents(spark, sf).withColumn("w", T.words(col("text")))
    zipped = docs.select("doc_id", F.arrays_zip("w", F.transform("w", lambda w: F.length(w)).alias("n")).alias("z"))
    return zipped.select("doc_id", F.posexplode("z").alias("p", "z")).select(
        "doc_id", (col("p") + 1).cast("bigint").alias("begin"), col("z.w").alias("chunk"), col("z.n").cast("bigint").alias("n")
    )


# ---------------------------------------------------------------- filters


@query(
    "pf1_non_null_text",
    "SELECT count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, count(v) AS n_text FROM "
    "(SELECT CASE WHEN n_chars % 5 <> 0 THEN text END AS v FROM documents)",
)
def _(spark, sf):
    return filters.text_counts(documents(spark, sf).select(F.when(col("n_chars") % 5 != 0, col("text")).alias("v")), "v")


@query(
    "pf2_any_text_present",
    "SELECT doc_id FROM documents WHERE (n_chars % 3 <> 0 AND trim(text) <> '') OR (lang = 'en' AND trim(source) <> '')",
)
def _(spark, sf):
    two = documents(spark, sf).select(
        "doc_id", F.when(col("n_chars") % 3 != 0, col("text")).alias("a"), F.when(col("lang") == "en", col("source")).otherwise(" ").alias("b")
    )
    return filters.keep_any_text(two, ["a", "b"]).select("doc_id")


WC = "CASE WHEN length(trim(text)) > 0 THEN len(string_split_regex(trim(text), '\\s+')) ELSE 0 END"


@query(
    "pf3_word_count_guard",
    f"SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN w < 4 THEN 'fewer than 4 words' "
    f"WHEN w > 300 THEN 'more than 300 words' END AS reason FROM (SELECT {WC} AS w FROM documents)) GROUP BY 1",
)
def _(spark, sf):
    return filters.guard_words(documents(spark, sf), "text").groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("pf5_truncate_text", "SELECT doc_id, left(text, 5000) AS text FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.truncate(col("text"), 5000).alias("text"))


@query("pf6_text_preview", "SELECT doc_id, left(text, 50) || '...' AS preview FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.preview(col("text")).alias("preview"))


@query(
    "pf7_route_errors",
    "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'record without id' WHEN turn % 4 = 3 THEN 'empty text' END AS error FROM conversations "
    "WHERE conv_id % 11 = 0 OR turn % 4 = 3 UNION ALL SELECT conv_id, turn, 'none' FROM conversations WHERE conv_id % 11 <> 0 AND turn % 4 <> 3",
)
def _(spark, sf):
    records = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(col("conv_id") % 11 != 0, col("role")).alias("patient_id"), F.when(col("turn") % 4 != 3, col("text")).otherwise(" ").alias("text")
    )
    ok, err = filters.route(records, filters.record_problem("patient_id", "text"))
    return ok.select("conv_id", "turn", F.lit("none").alias("error")).unionAll(err.select("conv_id", "turn", "error"))


@query("pf11_insert_after", "SELECT doc_id, text, left(text, 50) || '...' AS text_preview, lang, upper(lang) AS lang_upper FROM documents")
def _(spark, sf):
    wide = documents(spark, sf).select("doc_id", "text", "lang", T.preview(col("text")).alias("text_preview"), F.upper("lang").alias("lang_upper"))
    placed = filters.insert_after(wide, {"text": "text_preview", "lang": "lang_upper"})
    if placed.columns != ["doc_id", "text", "text_preview", "lang", "lang_upper"]:
        raise AssertionError(placed.columns)
    return placed


@query(
    "pf12_position_slice",
    "SELECT p AS position, event_id, value FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS p, event_id, value FROM events) WHERE p >= 5500 AND p < 6500",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("ts", "event_id", "value")
    return filters.slice_rows(events, [col("ts"), col("event_id")], 5500, 6500).select("position", "event_id", "value")


PROFILE = {n: "(" + ", ".join(lit(w) for w in ws) + ")" for n, ws in V.LANGUAGE_WORDS.items()}
LANGUAGE_SQL = (
    "SELECT doc_id, CASE WHEN length(trim(text)) < 10 OR greatest(c1, c2, c3, c4) = 0 THEN 'unknown' WHEN c1 >= greatest(c2, c3, c4) THEN 'en' "
    "WHEN c2 >= greatest(c3, c4) THEN 'fr' WHEN c3 >= c4 THEN 'de' ELSE 'es' END AS language, lang, text FROM (SELECT doc_id, lang, text, "
    + ", ".join(f"len(list_filter(ws, lambda w: w IN {PROFILE[n]})) AS c{i + 1}" for i, n in enumerate(V.LANGUAGE_WORDS))
    + r" FROM (SELECT doc_id, lang, text, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents))"
)


@query("tx19_detect_language", f"SELECT doc_id, language FROM ({LANGUAGE_SQL})")
def _(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", T.detect_language(col("text")).alias("language"))


def sql_grams(source: str, keys: str) -> str:
    """SELECT of (keys, gram, n) with the counts of the 1- to 3-grams of the words of ``text``."""
    return rf"""SELECT {keys}, gram, sum(m) AS n FROM (
      SELECT {keys}, m, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)))) AS gram
      FROM (SELECT {keys}, '_' || w || '_' AS w, count(*) AS m FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM {source}) GROUP BY ALL)) WHERE gram <> '_' GROUP BY ALL"""


PROFILES_SQL = f"""train AS (SELECT * FROM documents WHERE doc_id % 2 = 0),
    prof AS (SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank FROM ({sql_grams('train', 'lang')}) QUALIFY rank <= 300),
    own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM ({sql_grams('documents', 'doc_id')}) QUALIFY rank <= 300),
    away AS (SELECT doc_id, lang, sum(abs(coalesce(p.rank, 300 + own.rank) - own.rank)) AS d FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) LEFT JOIN prof p USING (lang, gram) GROUP BY doc_id, lang),
    best AS (SELECT doc_id, lang FROM away QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1),
    told AS (SELECT d.doc_id, d.lang, CASE WHEN length(trim(text)) >= 10 THEN coalesce(b.lang, 'unknown') ELSE 'unknown' END AS language FROM documents d LEFT JOIN best b USING (doc_id))"""


def by_profile(spark, sf):
    """Languages by the profiles of every second document."""
    docs = spread(documents(spark, sf))
    return language.detect_by_profile(docs, "text", language.language_profiles(docs.where("doc_id % 2 = 0"), "text", "lang"))


@query("tx19_language_profiles", f"WITH {PROFILES_SQL} SELECT lang, gram, CAST(n AS BIGINT) AS n, rank FROM prof")
def _(spark, sf):
    return language.language_profiles(documents(spark, sf).where("doc_id % 2 = 0"), "text", "lang").select(col("language").alias("lang"), "gram", "n", col("rank").cast("bigint").alias("rank"))


@query("tx19_language_by_profile", f"WITH {PROFILES_SQL} SELECT doc_id, language FROM told")
def _(spark, sf):
    return by_profile(spark, sf).select("doc_id", "language")


@query("tx19_profile_accuracy", f"WITH {PROFILES_SQL} SELECT lang, count(*) AS n, true AS nine_in_ten FROM told WHERE doc_id % 2 = 1 AND language <> 'unknown' GROUP BY lang")
def _(spark, sf):
    """Of the documents that the profiles were not counted from, nine in ten of each language are told right."""
    held = by_profile(spark, sf).where("doc_id % 2 = 1 and language <> 'unknown'")
    return held.groupBy("lang").agg(F.count("*").alias("n"), (F.count_if(col("lang") == col("language")) >= 0.9 * F.count("*")).alias("nine_in_ten"))


@query(
    "pf13_filter_english",
    f"SELECT count(*) AS n_rows, count(*) FILTER (language = 'en') AS n_kept, round(count(*) FILTER (language = 'en') * 100.0 / count(*), 4) AS percent FROM ({LANGUAGE_SQL})",
)
def _(spark, sf):
    return filters.language_share(spread(documents(spark, sf)), ["text"])


# ---------------------------------------------------------------- text functions


def _strip(sql: str) -> str:
    return f"trim({sql}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query("tx1_lower_strip_punct", f"SELECT doc_id, nullif({_strip(f'translate(lower(text), {lit(V.PUNCTUATION)}, {lit(chr(0)[:0])})')}, '') AS clean FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.lower_clean(col("text")).alias("clean"))


def clean_sql(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), 'http\\S+|www\\S+', '', 'g'), "
        f"'\\S+@\\S+', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


@query("tx2_clean_text", f"SELECT page_id AS id, {clean_sql('url || chr(32) || html')} AS clean FROM pages UNION ALL SELECT doc_id, {clean_sql('text')} FROM documents")
def _(spark, sf):
    pages = table(spark, sf, "pages").select(col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text"))
    both = pages.unionAll(documents(spark, sf).select("doc_id", "text"))
    return both.select("id", T.clean_text(col("text")).alias("clean"))


@query(
    "tx3_normalise_text",
    r"SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), "
    f"lambda w: w <> '' AND lower(w) NOT IN {STOPS}), ' ') AS norm FROM benchmark UNION ALL "
    r"SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), "
    f"lambda w: w <> '' AND lower(w) NOT IN {STOPS}), ' ') FROM documents",
)
def _(spark, sf):
    both = table(spark, sf, "benchmark").select("item_id", "text").unionAll(documents(spark, sf).select("doc_id", "text"))
    return both.select("item_id", T.normalise(col("text")).alias("norm"))


@query("tx4_squeeze_whitespace", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.squeeze(col("text")).alias("text"))


@query(
    "tx5_split_sentences",
    r"SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS position, unnest(ss) AS sentence FROM "
    r"(SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)",
)
def _(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.sentences(col("text"))).alias("position", "sentence")).withColumn(
        "position", col("position").cast("bigint")
    )


@query(
    "tx6_tokenise",
    r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS ms, string_split_regex(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS gaps
    FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000000 + doc_id, text FROM documents)),
    u AS (SELECT item_id, unnest(ms) AS token, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM t)
    SELECT item_id, i - 1 AS position, token, CAST(sum(length(gap) + length(token)) OVER (PARTITION BY item_id ORDER BY i) - length(token) AS BIGINT) AS start FROM u""",
)
def _(spark, sf):
    both = table(spark, sf, "benchmark").select("item_id", "text").unionAll(
        documents(spark, sf).select((col("doc_id") + 1000000000).alias("item_id"), "text")
    )
    return spread(both).select("item_id", F.posexplode(T.token_spans(col("text"))).alias("position", "t")).select(
        "item_id", col("position").cast("bigint").alias("position"), col("t.text").alias("token"), col("t.start").cast("bigint").alias("start")
    )


NORMALISED = f"list_filter(list_transform({TOKENS}, lambda t: lower(regexp_replace(t, '[^A-Za-z]', '', 'g'))), lambda t: t <> '')"


@query("tx7_normalise_tokens", f"SELECT doc_id, array_to_string({NORMALISED}, ' ') AS tokens FROM documents")
def _(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", F.array_join(T.normalise_tokens(T.tokens(col("text"))), " ").alias("tokens"))


@query(
    "tx8_remove_stop_words",
    f"SELECT doc_id, array_to_string(list_filter({WORDS}, lambda w: lower(w) NOT IN {STOPS} AND lower(w) NOT IN ('said', 'mr') AND length(w) >= 3), ' ') AS kept FROM documents",
)
def _(spark, sf):
    return spread(documents(spark, sf)).select(
        "doc_id", F.array_join(T.remove_stops(T.words(col("text")), extra=["said", "mr"], min_length=3), " ").alias("kept")
    )


CONTENT = (
    f"list_filter(list_transform({TOKENS}, lambda t: lower(t)), lambda t: t NOT IN {STOPS} AND regexp_matches(t, '[\\p{{L}}\\p{{N}}_]') "
    "AND NOT regexp_matches(t, '^[0-9][0-9.,]*$') AND length(t) > 1)"
)


@query("tx9_content_tokens", f"SELECT doc_id, array_to_string({CONTENT}, ' ') AS tokens FROM documents")
def _(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", F.array_join(T.content_tokens(col("text")), " ").alias("tokens"))


PIECES = r"regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '(?:https?://|www\.)\S+|\S+@\S+\.\S+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
DROPPED = rf"(lower(t) IN {STOPS} OR NOT regexp_matches(t, '[\p{{L}}\p{{N}}_]') OR regexp_matches(t, '(?i)^(?:https?://|www\.)\S+$|^\S+@\S+\.\S+$'))"


@query(
    "tx12_kept_vs_removed",
    f"SELECT doc_id, array_to_string(list_filter({PIECES}, lambda t: NOT {DROPPED}), ' ') AS kept, array_to_string(list_filter({PIECES}, lambda t: {DROPPED}), ' ') AS removed FROM documents",
)
def _(spark, sf):
    kept, removed = T.kept_and_removed(col("text"))
    return spread(documents(spark, sf)).select("doc_id", kept.alias("kept"), removed.alias("removed"))


@query("tx13_word_count", f"SELECT doc_id, CAST({WC} AS BIGINT) AS n_words FROM documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", T.word_count(col("text")).cast("bigint").alias("n_words"))


@query(
    "tx14_join_terms",
    f"SELECT doc_id, array_to_string(k, ' ') AS blank, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') END AS missing FROM (SELECT doc_id, list_filter({WORDS}, lambda w: length(w) > 24) AS k FROM documents)",
)
def _(spark, sf):
    k = F.filter(T.words(col("text")), lambda w: F.length(w) > 24)
    return documents(spark, sf).select("doc_id", k.alias("k")).select("doc_id", T.join_terms(col("k"), "").alias("blank"), T.join_terms(col("k"), None).alias("missing"))


@query(
    "wn5_ngrams_cumulative",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    g AS (SELECT doc_id, 1 AS n, unnest(w) AS gram FROM w
      UNION ALL SELECT doc_id, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w
      UNION ALL SELECT doc_id, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2])) FROM w)
    SELECT n, gram, count(*) AS freq FROM g GROUP BY n, gram""",
)
def _(spark, sf):
    # a blank-separated word may itself contain the delimiter, so each length is exploded by itself
    by_n = [
        spread(documents(spark, sf)).select(F.lit(n).cast("bigint").alias("n"), F.explode(T.ngrams(T.words(col("text")), n, cumulative=False)).alias("gram"))
        for n in (1, 2, 3)
    ]
    return by_n[0].unionAll(by_n[1]).unionAll(by_n[2]).groupBy("n", "gram").agg(F.count("*").alias("freq"))


# ---------------------------------------------------------------- arrays and vectors


@query(
    "se1_distinct_in_order",
    f"SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM (SELECT doc_id, w, min(i) AS i FROM "
    f"(SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS i FROM documents) GROUP BY doc_id, w) GROUP BY doc_id",
)
def _(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", F.array_join(T.distinct_terms(T.words(col("text"))), " ").alias("terms"))


@query(
    "se2_append_arrays",
    f"SELECT doc_id, array_to_string(list_concat(list_filter({WORDS}, lambda w: length(w) > 12), coalesce(CASE WHEN n_chars % 2 = 0 THEN list_filter({WORDS}, lambda w: length(w) < 3) END, [])), ' ') AS terms FROM documents",
)
def _(spark, sf):
    ws = T.words(col("text"))
    second = F.when(col("n_chars") % 2 == 0, F.filter(ws, lambda w: F.length(w) < 3))
    return spread(documents(spark, sf)).select(
        "doc_id", F.array_join(T.final_terms(F.filter(ws, lambda w: F.length(w) > 12), second), " ").alias("terms")
    )


# seven sums over all entries of an embedding, every seventh one from each start
EMB = "list_transform(range(1, 8), lambda k: list_reduce(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: i % 7 = k % 7), lambda i: CAST(embedding[i] AS DOUBLE)), lambda a, b: a + b))"
EMO = "[" + ", ".join(lit(x) for x in V.LABEL_SETS["emotion"]) + "]"
SOFT = f"(SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p FROM (SELECT vec_id, {EMB} AS l FROM embeddings))"


def _probs(spark, sf):
    entry = lambda k: F.filter("embedding", lambda x, i: (i + 1) % 7 == k % 7)
    logits = F.array(*[F.aggregate(entry(k), F.lit(0.0), lambda a, x: a + x.cast("double")) for k in range(1, 8)])
    return table(spark, sf, "embeddings").select("vec_id", SC.softmax(logits).alias("p"))


@query("tx27_softmax", f"SELECT vec_id, round(p[1], 9) AS first_p, round(p[7], 9) AS last_p, round(list_sum(p), 9) AS total FROM {SOFT}")
def _(spark, sf):
    return _probs(spark, sf).select(
        "vec_id", F.round(F.get("p", 0), 9).alias("first_p"), F.round(F.get("p", 6), 9).alias("last_p"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 9).alias("total"),
    )


@query("so2_argmax_label", f"SELECT vec_id, ({EMO})[list_position(p, list_max(p))] AS label FROM {SOFT}")
def _(spark, sf):
    return _probs(spark, sf).select("vec_id", SC.argmax_label(col("p"), V.LABEL_SETS["emotion"]).alias("label"))


@query(
    "so3_ranked_labels",
    f"SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS BIGINT) AS rank, ({EMO})[i] AS label, round(q, 9) AS probability FROM (SELECT vec_id, unnest(p) AS q, generate_subscripts(p, 1) AS i FROM {SOFT})",
)
def _(spark, sf):
    ranked = _probs(spark, sf).select("vec_id", F.posexplode(SC.rank_labels(col("p"), V.LABEL_SETS["emotion"])).alias("rank", "r"))
    return ranked.select("vec_id", (col("rank") + 1).cast("bigint").alias("rank"), col("r.label").alias("label"), F.round("r.probability", 9).alias("probability"))


@query("sn11_emotion_columns", "SELECT vec_id, " + ", ".join(f"round(p[{i + 1}], 9) AS {x.lower()}" for i, x in enumerate(V.LABEL_SETS["emotion"])) + f", ({EMO})[list_position(p, list_max(p))] AS best, round(list_max(p), 9) AS score FROM {SOFT}")
def _(spark, sf):
    labels = V.LABEL_SETS["emotion"]
    wide = _probs(spark, sf).select("vec_id", "p", *SC.class_columns(col("p"), labels))
    return wide.select(
        "vec_id", *[F.round(x.lower(), 9).alias(x.lower()) for x in labels], SC.argmax_label(col("p"), labels).alias("best"), F.round(F.array_max("p"), 9).alias("score")
    )


@query("tx25_iso_label_normalise", "SELECT vec_id, CASE label % 4 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN '2 STARS' WHEN 2 THEN 'POSITIVE' ELSE 'JOY' END AS label FROM embeddings")
def _(spark, sf):
    raw = F.get(string_array(["LABEL_0", "2 stars", "Positive", "joy"]), (col("label") % 4).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", SC.normalise_label(raw).alias("label"))


@query("tx26_align_probabilities", "SELECT vec_id, round(CASE WHEN label % 2 = 0 THEN CAST(embedding[1] AS DOUBLE) ELSE 0 END, 9) AS negative, round(CAST(embedding[2] AS DOUBLE), 9) AS neutral, 0.0::DOUBLE AS positive FROM embeddings")
def _(spark, sf):
    x = [F.get("embedding", i).cast("double") for i in (0, 1)]
    m = F.when(col("label") % 2 == 0, F.create_map(F.lit("NEUTRAL"), x[1], F.lit("NEGATIVE"), x[0])).otherwise(F.create_map(F.lit("NEUTRAL"), x[1], F.lit("OTHER"), x[0]))
    p = SC.align(m, V.LABEL_SETS["ternary"])
    return table(spark, sf, "embeddings").select("vec_id", p.alias("p")).select("vec_id", *[F.round(F.get("p", i), 9).alias(n) for i, n in enumerate(["negative", "neutral", "positive"])])


@query("tx28_map_lookup_by_value", "SELECT vec_id, round(CAST(embedding[label % len(embedding) + 1] AS DOUBLE), 9) AS confidence FROM embeddings")
def _(spark, sf):
    names = F.transform("embedding", lambda x, i: F.concat(F.lit("label "), i.cast("string")))
    meta = F.map_from_arrays(names, F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(SC.label_confidence(meta, F.concat(F.lit("label "), (col("label") % F.size("embedding")).cast("string"))), 9).alias("confidence"))


@query("tx29_star_bucket", "SELECT vec_id, CASE label % 5 + 1 WHEN 1 THEN 'negative' WHEN 2 THEN 'negative' WHEN 3 THEN 'neutral' ELSE 'positive' END AS bucket FROM embeddings")
def _(spark, sf):
    stars = (col("label") % 5 + 1).cast("string")
    return table(spark, sf, "embeddings").select("vec_id", SC.star_bucket(F.when(stars == "1", "1 star").otherwise(F.concat(stars, F.lit(" stars")))).alias("bucket"))


@query("so5_longest_first", f"SELECT doc_id, array_to_string(list_transform(list_sort(list_transform({WORDS}, lambda w: struct_pack(n := -length(w), w := w))), lambda s: s.w), ' ') AS terms FROM documents")
def _(spark, sf):
    return spread(documents(spark, sf)).select("doc_id", F.array_join(M.longest_first(T.words(col("text"))), " ").alias("terms"))

