"""Finding personal data; span algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.functions import masks as M
from textspark.functions import spans as S
from textspark.operators import pii
from textspark.resources import values as V

from .base import NOTES, RE2_DETECTORS, documents, lit, notes, query, spread, sql_matches, sql_replace, sql_structured, table

col = F.col
SPAN_COLUMNS = ["CAST(start AS bigint) AS start", "CAST(`end` AS bigint) AS stop", "text", "label"]


def long(df, spans, key):
    """Span rows with plain types."""
    return pii.explode_spans(df, spans, [key]).selectExpr(key, *SPAN_COLUMNS)


@query("pi1_regex_entities", f"WITH {NOTES}, {sql_structured('notes', 'note_id')} SELECT note_id, s AS start, e AS stop, txt AS text, label FROM spans")
def _(spark, sf):
    return long(spread(notes(spark, sf)).withColumn("spans", pii.structured_spans(col("text"))), "spans", "note_id")


@query("pi1_regex_entities_documents", f"WITH {sql_structured('documents', 'doc_id')} SELECT doc_id, s AS start, e AS stop, txt AS text, label FROM spans")
def _(spark, sf):
    return long(spread(documents(spark, sf)).withColumn("spans", pii.structured_spans(col("text"))), "spans", "doc_id")


LUHN = (
    "(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse(d), i, 1) AS INT) * 2 "
    "- CASE WHEN CAST(substr(reverse(d), i, 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substr(reverse(d), i, 1) AS INT) END)) % 10 = 0)"
)


def sql_detectors(source: str, key: str, names, check_cards: bool = True, name: str = "spans", listed: dict[str, str] | None = None) -> str:
    """CTEs: matches, the listed-first rule, then left-to-right clearing by a recursive walk; ``listed`` has further patterns."""
    patterns = RE2_DETECTORS | (listed or {})
    parts = "\n UNION ALL ".join(sql_matches(source, key, n, patterns[n], i) for i, n in enumerate(names))
    cards = f"WHERE label <> 'CREDIT_CARD' OR {LUHN}" if check_cards else ""
    rules = ""
    previous = f"{name}_r0"
    steps = [f"{previous} AS (SELECT * FROM {name}_ok WHERE rank = 0)"]
    for i in range(1, len(names)):
        steps.append(
            f"{name}_r{i} AS (SELECT * FROM {previous} UNION ALL SELECT * FROM {name}_ok a WHERE rank = {i} AND NOT EXISTS "
            f"(SELECT 1 FROM {previous} b WHERE b.{key} = a.{key} AND a.s < b.e AND b.s < a.e))"
        )
        previous = f"{name}_r{i}"
    rules = ",\n".join(steps)
    return (
        f"{name}_all AS ({parts}), {name}_ok AS (SELECT {key}, s, e, txt, label, rank FROM (SELECT *, regexp_replace(txt, '[^0-9]', '', 'g') AS d FROM {name}_all) {cards}),\n"
        f"{rules},\n{name} AS (SELECT * FROM {previous})"
    )


@query(
    "pi2_entity_type_detectors",
    f"WITH {sql_detectors('documents', 'doc_id', list(RE2_DETECTORS))} SELECT doc_id, s AS start, e AS stop, txt AS text, label FROM spans",
)
def _(spark, sf):
    return long(pii.detect(spread(documents(spark, sf)), "text"), "spans", "doc_id")


@query(
    "pi2_detectors_without_checksum",
    f"WITH {sql_detectors('documents', 'doc_id', ['EMAIL_ADDRESS', 'CREDIT_CARD', 'IP_ADDRESS'], False)} SELECT doc_id, s AS start, e AS stop, txt AS text, label FROM spans",
)
def _(spark, sf):
    return long(pii.detect(spread(documents(spark, sf)), "text", ["EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS"], check_cards=False), "spans", "doc_id")


@query(
    "pi2_notes",
    f"WITH {NOTES}, {sql_detectors('notes', 'note_id', ['EMAIL_ADDRESS', 'DATE_TIME', 'PHONE_NUMBER', 'US_SSN'])} SELECT label, count(*) AS n FROM spans GROUP BY label",
)
def _(spark, sf):
    found = pii.detect(spread(notes(spark, sf)), "text", ["EMAIL_ADDRESS", "DATE_TIME", "PHONE_NUMBER", "US_SSN"])
    return pii.explode_spans(found, "spans", ["note_id"]).groupBy("label").agg(F.count("*").alias("n"))


def sql_whole_words(text: str, start: str, end: str) -> str:
    """Condition that a match neither begins nor ends inside a word of any script."""
    return rf"NOT regexp_matches(left({text}, CAST({start} AS BIGINT)), '[\p{{L}}\p{{N}}_][#''’-]*$') AND NOT regexp_matches(substr({text}, CAST({end} + 1 AS BIGINT), 20), '^[#''’-]*[\p{{L}}\p{{N}}_]')"


# ---------------------------------------------------------------- gazetteer: names from a list, places from the nation table


def gazetteer(spark, sf):
    """People from the name lists, places from ``nation``, things from the distinct part names."""
    people = table(spark, sf, "customer").select(
        F.lower(F.concat(F.element_at(F.array(*[F.lit(x) for x in V.FAKE_FIRST]), (col("c_custkey") % 10 + 1).cast("int")), F.lit(" "),
                         F.element_at(F.array(*[F.lit(x) for x in V.FAKE_LAST]), (F.floor(col("c_custkey") / 10) % 10 + 1).cast("int")))).alias("phrase"),
        F.lit("NAME").alias("label"),
    )
    places = table(spark, sf, "nation").select(F.lower("n_name").alias("phrase"), F.lit("LOCATION").alias("label"))
    return people.unionAll(places).distinct()


def _names(a):
    return "[" + ", ".join(lit(x) for x in a) + "]"


GAZETTEER = (
    f"gaz AS (SELECT DISTINCT lower(({_names(V.FAKE_FIRST)})[c_custkey % 10 + 1] || ' ' || ({_names(V.FAKE_LAST)})[(c_custkey // 10) % 10 + 1]) AS phrase, 'NAME' AS label FROM customer "
    "UNION SELECT lower(n_name), 'LOCATION' FROM nation)"
)


@query(
    "pi3_gazetteer_entities",
    rf"""WITH {NOTES}, {GAZETTEER}, w AS ({sql_matches('notes', 'note_id', 'w', '[A-Za-z0-9_](?:[A-Za-z0-9_#-]*[A-Za-z0-9_])?')}),
    n AS (SELECT note_id, s, lead(e, 0) OVER p AS e1, lead(e, 1) OVER p AS e2, lead(e, 2) OVER p AS e3 FROM w WINDOW p AS (PARTITION BY note_id ORDER BY s)),
    g AS (SELECT note_id, s, e1 AS e FROM n UNION ALL SELECT note_id, s, e2 FROM n WHERE e2 IS NOT NULL UNION ALL SELECT note_id, s, e3 FROM n WHERE e3 IS NOT NULL)
    SELECT g.note_id, g.s AS start, g.e AS stop, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS text, label FROM g JOIN notes USING (note_id)
    JOIN gaz ON phrase = lower(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)))""",
)
def _(spark, sf):
    return pii.gazetteer_spans(spread(notes(spark, sf)), "note_id", "text", gazetteer(spark, sf)).selectExpr("note_id", *SPAN_COLUMNS)


SOME_NAMES = "(?:" + "|".join(V.FAKE_FIRST) + ") (?:" + "|".join(V.FAKE_LAST) + ")"

ALL_ENTITIES = ["PERSON", "LOCATION", "DATE_TIME", "PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "NRP"]


@query(
    "pi2_people_places_and_patterns",
    f"WITH {NOTES}, {sql_detectors('notes', 'note_id', ALL_ENTITIES, listed={'PERSON': SOME_NAMES, 'LOCATION': 'NATION_[0-9]+', 'NRP': '(?i)' + chr(92) + 'b(?:chart opened|patient)' + chr(92) + 'b'})} "
    + sql_replace("notes", "note_id", "spans", "'[' || label || ']'", "redacted"),
)
def _(spark, sf):
    """Names, places and groups of people beside the patterns in one call; whole texts with their labels."""
    listed = gazetteer(spark, sf).withColumn("label", F.when(col("label") == "NAME", "PERSON").otherwise(col("label")))
    groups = spark.createDataFrame([("chart opened", "NRP"), ("patient", "NRP"), ("patient opened", "NRP")], "phrase string, label string")
    found = pii.detect(spread(notes(spark, sf)), "text", ALL_ENTITIES, dictionary=listed.unionByName(groups))
    return found.select("note_id", S.replace_spans(col("text"), col("spans"), M.label_text).alias("redacted"))


@query(
    "pi3_phrases_of_twelve_words",
    r"""WITH p AS (SELECT item_id, regexp_replace(lower(array_to_string(list_slice(string_split(text, ' '), 1, 12), ' ')), '[^\p{L}\p{N}]+$', '') AS phrase FROM benchmark),
    hits AS (SELECT doc_id, text, phrase, unnest(range(1, len(parts))) AS i, parts FROM (SELECT doc_id, text, phrase, string_split(lower(text), phrase) AS parts FROM documents, (SELECT DISTINCT phrase FROM p) WHERE contains(lower(text), phrase))),
    places AS (SELECT doc_id, text, phrase, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) AS BIGINT) AS s FROM hits)
    SELECT doc_id, s AS start, s + length(phrase) AS stop, substr(text, s + 1, length(phrase)) AS text, 'NRP' AS label FROM places
    WHERE """ + sql_whole_words("text", "s", "s + length(phrase)"),
)
def _(spark, sf):
    """The first twelve words of each benchmark item as a dictionary."""
    phrase = F.regexp_replace(F.lower(F.array_join(F.slice(F.split("text", " "), 1, 12), " ")), r"[^\p{L}\p{N}]+$", "")
    listed = table(spark, sf, "benchmark").select(phrase.alias("phrase"), F.lit("NRP").alias("label"))
    return pii.gazetteer_spans(spread(documents(spark, sf)), "doc_id", "text", listed).selectExpr("doc_id", *SPAN_COLUMNS)


NOTE_SPANS = f"{NOTES}, {sql_structured('notes', 'note_id')}"
NAME_SPANS_SQL = f""", names AS ({sql_matches('notes', 'note_id', 'NAME', SOME_NAMES)}),
  all_spans AS (SELECT note_id, s, e, txt, label FROM spans UNION ALL SELECT note_id, s, e, txt, label FROM names)"""


def named_notes(spark, sf):
    """Notes with NAME spans, found by a pattern over the name lists."""
    return spread(notes(spark, sf)).withColumn("spans", S.match_spans(col("text"), SOME_NAMES, "NAME", 0.9))


@query(
    "pi7_promote_provider",
    f"""WITH {NOTES}, spans AS ({sql_matches('notes', 'note_id', 'NAME', SOME_NAMES)})
    SELECT x.note_id, s AS start, CASE WHEN regexp_matches(substr(text, CAST(greatest(s - 20, 0) + 1 AS BIGINT), CAST(least(s, 20) AS BIGINT)), '(?i)\\b(Dr\\.?|Doctor|Prof\\.?|Professor|Nurse)\\s*$')
      OR regexp_matches(substr(text, CAST(e + 1 AS BIGINT), 40), '(?i)^\\s*,?\\s*\\b(MD|DO|NP|RN|PA|APRN|CRNA|DDS|DMD|OD|DVM|PhD|PharmD|FACS|FACP|FACOG|FAAN|LPN|LVN|CNM|CNA)\\b')
      THEN 'PROVIDER' ELSE 'NAME' END AS label FROM spans x JOIN notes n ON n.note_id = x.note_id""",
)
def _(spark, sf):
    df = named_notes(spark, sf).withColumn("spans", pii.promote_provider(col("text"), col("spans")))
    return pii.explode_spans(df, "spans", ["note_id"]).select("note_id", col("start").cast("bigint").alias("start"), "label")


@query(
    "pi4_context_rule_entities",
    rf"""WITH {NOTES}, w AS ({sql_matches('notes', 'note_id', 'w', '[^ ,;()]*[^ ,;().!?]')})
    SELECT w.note_id, s AS start, txt AS text FROM w JOIN notes n ON n.note_id = w.note_id
    WHERE regexp_matches(txt, '^\d{{2,3}}$') AND regexp_matches(left(text, CAST(s AS BIGINT)), '\baged $')""",
)
def _(spark, sf):
    spans = pii.context_spans(col("text"), "AGE", r"\d{2,3}", prefix=["aged"], context=40, exceptions=["SSN"], exception_distance=4)
    found = spread(notes(spark, sf)).withColumn("spans", spans)
    return pii.explode_spans(found, "spans", ["note_id"]).select("note_id", col("start").cast("bigint").alias("start"), "text")


LABELS = [*V.LABEL_TO_TYPE, "mystery_label"]
MODEL_LABEL_SQL = f"({_names(LABELS)})[l_partkey % {len(LABELS)} + 1]"


@query(
    "pi5_map_model_labels",
    f"""WITH m AS (SELECT * FROM (VALUES {", ".join(f"({lit(k)}, {lit(v)})" for k, v in V.LABEL_TO_TYPE.items())}) t(raw, kind)),
    s AS (SELECT l_orderkey, l_linenumber, {MODEL_LABEL_SQL} AS raw, l_suppkey % 4 AS mark FROM lineitem)
    SELECT coalesce(kind, 'OTHER_ID') AS label, count(*) AS n FROM s LEFT JOIN m USING (raw) WHERE mark <> 3 GROUP BY 1""",
)
def _(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in LABELS]), (col("l_partkey") % len(LABELS)).cast("int"))
    mark = col("l_suppkey") % 4
    label = F.when(mark == 0, raw).when(mark == 1, F.concat(F.lit("B-"), raw)).when(mark == 2, F.concat(F.lit("I-"), raw)).otherwise("O")
    items = table(spark, sf, "lineitem").select(
        F.array(S.span(col("l_linenumber"), col("l_linenumber") + 1, F.lit("x"), label, F.lit(1.0))).alias("spans")
    )
    return items.select(F.inline(pii.map_labels(col("spans")))).groupBy("label").agg(F.count("*").alias("n"))


def _entry(row) -> str:
    return ", ".join(lit("; ".join(x) if isinstance(x, list) else x) for x in row)


@query("pi12_catalogue", "SELECT * FROM (VALUES " + ", ".join("(" + _entry(row) + ", CAST(0 AS BIGINT))" for row in V.ENTITY_CATALOGUE if row[0] not in ("NAME", "SSN")) + ") t(entity_type, description, examples, replacement, n) UNION ALL SELECT " + _entry(V.ENTITY_CATALOGUE[0]) + ", 2 * count(*) FROM orders UNION ALL SELECT " + _entry(V.ENTITY_CATALOGUE[6]) + ", count(*) FROM orders")
def _(spark, sf):
    """The catalogue with the number of name and SSN spans in the notes."""
    found = named_notes(spark, sf).withColumn("spans", F.concat("spans", S.match_spans(col("text"), V.STRUCTURED_PATTERNS[0][1], "SSN")))
    counts = pii.explode_spans(found, "spans", ["note_id"]).groupBy(col("label").alias("entity_type")).agg(F.count("*").alias("n"))
    listed = pii.entity_catalogue(spark).withColumn("examples", F.array_join("examples", "; "))
    return listed.join(counts, "entity_type", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@query(
    "pi11_offsets_only",
    f"""WITH {NOTES}, {sql_structured('notes', 'note_id')}, n AS (SELECT note_id, count(*) AS entity_count FROM spans GROUP BY note_id)
    SELECT x.note_id, n.entity_count, left(text, 50) || '...' AS text_preview, label AS type, 1.0::DOUBLE AS score, s AS begin_offset, e AS end_offset
    FROM spans x JOIN notes t ON t.note_id = x.note_id JOIN n ON n.note_id = x.note_id""",
)
def _(spark, sf):
    out = pii.offsets_table(pii.structured(spread(notes(spark, sf)), "text"), "note_id", "text", "spans")
    return out.withColumns({c: col(c).cast("bigint") for c in ("entity_count", "begin_offset", "end_offset")})


@query(
    "pi13_has_pii_flag",
    f"""WITH {sql_structured('documents', 'doc_id')}, n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
    SELECT count(*) AS n_docs, count(n) AS n_with, count(*) - count(n) AS n_without, CAST(sum(n) AS BIGINT) AS n_entities, round(sum(n) * 1000.0 / sum(length(text)), 6) AS per_1000_chars
    FROM documents LEFT JOIN n USING (doc_id)""",
)
def _(spark, sf):
    return pii.pii_profile(spread(documents(spark, sf)).withColumn("spans", pii.structured_spans(col("text"))), "spans", "text")


@query(
    "ag2_entities_by_type",
    f"WITH {NOTES}, {sql_structured('notes', 'note_id')} SELECT label, count(*) AS n_entities, count(DISTINCT note_id) AS n_docs FROM spans GROUP BY label",
)
def _(spark, sf):
    spans = pii.explode_spans(spread(notes(spark, sf)).withColumn("spans", pii.structured_spans(col("text"))), "spans", ["note_id"])
    return pii.label_stats(spans, "note_id")


@query(
    "ag3_batch_totals",
    f"WITH {NOTES}, {sql_structured('notes', 'note_id')} SELECT (SELECT count(*) FROM notes) AS documents, count(*) AS entities, max(n) AS most, min(n) AS least FROM (SELECT *, count(*) OVER (PARTITION BY note_id) AS n FROM spans)",
)
def _(spark, sf):
    df = spread(notes(spark, sf)).select(pii.structured_spans(col("text")).alias("spans"))
    return pii.batch_totals(df, "spans")


# ---------------------------------------------------------------- span algebra on spans derived from lineitem


BODY = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINE_SPANS = f"""ls AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 40 AS s, l_partkey % 40 + 1 + l_suppkey % 8 AS e,
    CASE l_suppkey % 3 WHEN 0 THEN 'NAME' WHEN 1 THEN 'DATE' ELSE 'ID' END AS label, round(0.5 + l_discount * 4, 4) AS c,
    l_partkey, l_suppkey, l_linenumber FROM lineitem)"""


def line_spans(spark, sf):
    """One row per order with 1..7 overlapping spans over a fixed text, in line order."""
    start = (col("l_partkey") % 40).cast("int")
    end = (start + 1 + col("l_suppkey") % 8).cast("int")
    label = F.get(F.array(*[F.lit(x) for x in ("NAME", "DATE", "ID")]), (col("l_suppkey") % 3).cast("int"))
    one = S.span(start, end, S.piece(F.lit(BODY), start, end), label, F.round(F.lit(0.5) + col("l_discount") * 4, 4))
    # ties in start are ordered by everything else, as the whole struct is sorted
    return table(spark, sf, "lineitem").groupBy(col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(one)).alias("spans")).withColumn("text", F.lit(BODY))


def flat(df, column="spans"):
    return df.select("k", F.inline(column)).select("k", col("start").cast("bigint").alias("start"), col("end").cast("bigint").alias("stop"), "label", "confidence")


@query(
    "wn2_merge_adjacent_spans",
    f"""WITH {LINE_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, label, c) AS r FROM ls),
    b AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS turn FROM o WINDOW w AS (PARTITION BY k ORDER BY r)),
    t AS (SELECT *, sum(turn) OVER (PARTITION BY k ORDER BY r) AS run FROM b),
    g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k, run ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM t),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY k, run ORDER BY r) AS island FROM g)
    SELECT k, min(s) AS start, max(e) AS stop, label, max(c) AS confidence FROM i GROUP BY k, run, island, label""",
)
def _(spark, sf):
    df = line_spans(spark, sf)
    return flat(df.withColumn("spans", S.merge_adjacent(col("text"), col("spans"))))


@query(
    "wn4_greedy_non_overlap",
    f"""WITH RECURSIVE {LINE_SPANS}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e, label, c) AS r FROM ls),
    kept AS (SELECT k, s, e, label, c, r FROM o WHERE r = 1
      UNION ALL SELECT o.k, o.s, o.e, o.label, o.c, o.r FROM kept JOIN o ON o.k = kept.k AND o.s >= kept.e
        AND o.r = (SELECT min(r) FROM o x WHERE x.k = kept.k AND x.s >= kept.e))
    SELECT k, s AS start, e AS stop, label, c AS confidence FROM kept""",
)
def _(spark, sf):
    return flat(line_spans(spark, sf).withColumn("spans", S.non_overlapping(col("spans"))))


@query(
    "wn3_prefer_source_merge",
    f"""WITH {LINE_SPANS} SELECT k, s AS start, e AS stop, label, c AS confidence FROM ls WHERE label = 'NAME'
    UNION ALL SELECT k, s, e, label, c FROM ls a WHERE label = 'DATE' AND NOT EXISTS (SELECT 1 FROM ls b WHERE b.k = a.k AND b.label = 'NAME' AND a.s < b.e AND b.s < a.e)""",
)
def _(spark, sf):
    names, others = S.keep_labels(col("spans"), allow=["NAME"]), S.keep_labels(col("spans"), deny=["NAME"])
    return flat(line_spans(spark, sf).withColumn("spans", pii.merge_chunks(names, S.keep_labels(others, deny=["ID"]))))


@query(
    "pi8_regex_vs_model_priority",
    f"""WITH {LINE_SPANS}, regex AS (SELECT * FROM ls WHERE label = 'DATE'), model AS (SELECT * FROM ls WHERE label = 'NAME')
    SELECT k, s AS start, e AS stop, label, 'regex first' AS rule FROM regex
    UNION ALL SELECT k, s, e, label, 'regex first' FROM model a WHERE NOT EXISTS (SELECT 1 FROM regex b WHERE b.k = a.k AND a.s < b.e AND b.s < a.e)
    UNION ALL SELECT k, s, e, label, 'model first' FROM model
    UNION ALL SELECT k, s, e, label, 'model first' FROM regex a WHERE NOT EXISTS (SELECT 1 FROM model b WHERE b.k = a.k AND a.s < b.e AND b.s < a.e)
    UNION ALL SELECT k, s, e, label, 'denied' FROM model""",
)
def _(spark, sf):
    df = line_spans(spark, sf)
    regex, model = S.keep_labels(col("spans"), allow=["DATE"]), S.keep_labels(col("spans"), allow=["NAME"])
    rules = {
        "regex first": pii.regex_or_model(model, regex, override=True),
        "model first": pii.regex_or_model(model, S.no_spans(), custom_regex=regex, combine=True),
        "denied": pii.regex_or_model(model, regex, deny=["DATE"]),
    }
    parts = F.flatten(F.array(*[F.transform(c, _tag(n)) for n, c in rules.items()]))
    return df.select("k", F.inline(parts)).select("k", col("start").cast("bigint").alias("start"), col("end").cast("bigint").alias("stop"), "label", "rule")


def _tag(rule):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.lit(rule).alias("rule"))


@query(
    "pi9_merge_two_models",
    f"""WITH {LINE_SPANS}, a AS (SELECT * FROM ls WHERE l_linenumber <= 3 AND label IN ('NAME', 'ID')), b AS (SELECT * FROM ls WHERE l_linenumber > 3 AND label IN ('DATE', 'ID'))
    SELECT k, s AS start, e AS stop, label, c AS confidence FROM b UNION ALL
    SELECT k, s, e, label, c FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND a.s < b.e AND b.s < a.e)""",
)
def _(spark, sf):
    items = table(spark, sf, "lineitem")
    generic = line_spans_of(items.filter("l_linenumber <= 3"), "generic")
    sub = line_spans_of(items.filter("l_linenumber > 3"), "sub")
    both = generic.join(sub, "k", "full").withColumns({c: F.coalesce(c, S.no_spans()) for c in ("generic", "sub")})
    merged = pii.merge_chunks(S.keep_labels(col("sub"), allow=["DATE", "ID"]), S.keep_labels(col("generic"), allow=["NAME", "ID"]))
    return flat(both.select("k", merged.alias("spans")))


def line_spans_of(items, name):
    start = (col("l_partkey") % 40).cast("int")
    end = (start + 1 + col("l_suppkey") % 8).cast("int")
    label = F.get(F.array(*[F.lit(x) for x in ("NAME", "DATE", "ID")]), (col("l_suppkey") % 3).cast("int"))
    one = S.span(start, end, F.lit(""), label, F.round(F.lit(0.5) + col("l_discount") * 4, 4))
    return items.groupBy(col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(one)).alias(name))


@query("pf8_label_whitelist", f"WITH {LINE_SPANS} SELECT k, s AS start, e AS stop, label, c AS confidence FROM ls WHERE label IN ('NAME', 'DATE') AND label <> 'DATE'")
def _(spark, sf):
    return flat(line_spans(spark, sf).withColumn("spans", S.keep_labels(col("spans"), ["NAME", "DATE"], ["DATE"])))


@query("pf9_confidence_filter", f"WITH {LINE_SPANS} SELECT k, s AS start, e AS stop, label, c AS confidence FROM ls WHERE c >= 0.7")
def _(spark, sf):
    return flat(line_spans(spark, sf).withColumn("spans", S.min_confidence(col("spans"), 0.7)))


@query("se3_union_span_sets", f"WITH {LINE_SPANS} SELECT label, count(*) AS n FROM (SELECT * FROM ls WHERE c >= 0.7 UNION ALL SELECT * FROM ls WHERE label = 'ID') GROUP BY label")
def _(spark, sf):
    df = line_spans(spark, sf)
    strong = pii.explode_spans(df.withColumn("spans", S.min_confidence(col("spans"), 0.7)), "spans", ["k"])
    ids = pii.explode_spans(df.withColumn("spans", S.keep_labels(col("spans"), ["ID"])), "spans", ["k"])
    return pii.union_spans(strong, ids).groupBy("label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- token tags

TAG_SQL = "CASE length(w) % 5 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'I-LOC' ELSE 'O' END"


def tagged(spark, sf):
    """Tokens of the benchmark items and documents with a tag made from the token length."""
    both = table(spark, sf, "benchmark").select("item_id", "text").unionAll(documents(spark, sf).select((col("doc_id") + 1000000000).alias("item_id"), "text"))
    toks = spread(both).select("item_id", S.match_spans(col("text"), r"\S+", "w").alias("toks"))
    n = lambda t: F.length(t["text"]) % 5
    tags = F.transform("toks", lambda t: F.when(n(t) == 0, "B-PER").when(n(t) == 1, "I-PER").when(n(t) == 2, "I-LOC").otherwise("O"))
    return toks.withColumn("tags", tags)


@query(
    "wn1_iob_to_chunks",
    rf"""WITH src AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000000 + doc_id, text FROM documents),
    w AS (SELECT item_id, s, e, {TAG_SQL.replace('w)', 'txt)')} AS tag FROM ({sql_matches('src', 'item_id', 'w', chr(92) + 'S+')})),
    b AS (SELECT *, CASE WHEN tag <> 'O' AND starts_with(tag, 'I-') AND lag(tag) OVER p <> 'O' AND substr(lag(tag) OVER p, 3) = substr(tag, 3) THEN 0 ELSE 1 END AS fresh FROM w WINDOW p AS (PARTITION BY item_id ORDER BY s)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY s) AS island FROM b)
    SELECT item_id, min(s) AS start, max(e) AS stop, substr(min(tag), 3) AS label FROM i WHERE tag <> 'O' GROUP BY item_id, island""",
)
def _(spark, sf):
    chunks = tagged(spark, sf).select("item_id", F.inline(pii.iob_to_spans(col("toks"), col("tags"))))
    return chunks.select("item_id", col("start").cast("bigint").alias("start"), col("end").cast("bigint").alias("stop"), "label")


@query(
    "pi10_overwrite_tags",
    rf"""SELECT tag, count(*) AS n FROM (SELECT CASE WHEN w IN ('the', 'of', 'la', 'die') THEN 'B-MISC' ELSE {TAG_SQL} END AS tag
    FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents))) GROUP BY tag""",
)
def _(spark, sf):
    df = tagged(spark, sf)
    new = pii.overwrite_tags(F.transform("toks", lambda t: t["text"]), col("tags"), ["the", "of", "la", "die"], "B-MISC")
    return df.select(F.explode(new).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


