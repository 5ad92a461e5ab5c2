"""De-identification: span strategies, pseudonyms, dates, ages, columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from textspark.functions import masks as M
from textspark.functions import spans as S
from textspark.functions import text as T
from textspark.operators import deid, pii, pools
from textspark.resources import values as V

from .base import NOTES, RE2_PATTERNS, _list, documents, lit, notes, query, spread, sql_matches, sql_replace, sql_structured, table
from .pii_checks import NAME_SPANS_SQL, NOTE_SPANS, SOME_NAMES, sql_detectors, sql_whole_words
from .text_checks import LANGUAGE_SQL

col = F.col


def found(spark, sf):
    """Notes with structured spans (no overlaps)."""
    return pii.structured(spread(notes(spark, sf)), "text")


def with_names(spark, sf):
    """Notes with structured and NAME spans."""
    spans = S.non_overlapping(F.concat(pii.structured_spans(col("text")), S.match_spans(col("text"), SOME_NAMES, "NAME")))
    return spread(notes(spark, sf)).withColumn("spans", spans)


def replaced(replacement: str, out: str = "out", names: bool = False) -> str:
    spans = "all_spans" if names else "spans"
    return f"WITH {NOTE_SPANS}{NAME_SPANS_SQL if names else ''} {sql_replace('notes', 'note_id', spans, replacement, out)}"


PLACEHOLDER = "CASE label " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.REPLACEMENT_TEXT.items()) + " ELSE '[' || label || ']' END"
SAME = "CASE WHEN length(txt) > 2 THEN '[' || repeat('*', length(txt) - 2) || ']' ELSE repeat('*', length(txt)) END"


def index_sql(key: str, seed, size: int) -> str:
    return f"(('0x' || substring(md5({key} || '|{seed}'), 1, 8))::BIGINT % {size})"


def pool_sql(pools, seed=42, key="txt") -> str:
    return "CASE label " + " ".join(f"WHEN {lit(k)} THEN ({_list(v)})[{index_sql(key, seed, len(v))} + 1]" for k, v in pools.items()) + " ELSE '[' || label || ']' END"


# ---------------------------------------------------------------- span strategies


@query("de1_replace_spans", replaced("'<' || upper(txt) || '>'"))
def _(spark, sf):
    return found(spark, sf).select("note_id", S.replace_spans(col("text"), col("spans"), lambda s: F.concat(F.lit("<"), F.upper(s["text"]), F.lit(">"))).alias("out"))


@query("de2_label_redaction", replaced("CASE WHEN label = 'ID' THEN txt ELSE '[' || label || ']' END"))
def _(spark, sf):
    return deid.redact_labels(found(spark, sf), "text", "spans", "out", skip=["ID"]).select("note_id", "out")


@query("de3_strategy_placeholder", replaced(PLACEHOLDER, names=True))
def _(spark, sf):
    return deid.deidentify(with_names(spark, sf), "text", "spans", "placeholder", "out").select("note_id", "out")


@query("de3_single_text", replaced("'ANON'"))
def _(spark, sf):
    return deid.deidentify(found(spark, sf), "text", "spans", single="ANON", out="out").select("note_id", "out")


@query("de4_strategy_redact", replaced("repeat('█', length(txt))"))
def _(spark, sf):
    return deid.deidentify(found(spark, sf), "text", "spans", "redact", "out").select("note_id", "out")


@query("de4_strategy_hash", replaced("'[' || label || '_' || substring(sha256(txt), 1, 8) || ']'"))
def _(spark, sf):
    return deid.deidentify(found(spark, sf), "text", "spans", "hash", "out").select("note_id", "out")


@query("de7_strategy_custom", replaced(f"CASE txt WHEN '1:00 PM' THEN 'noonish' WHEN '2:01 PM' THEN 'later' ELSE {PLACEHOLDER} END"))
def _(spark, sf):
    return deid.deidentify(found(spark, sf), "text", "spans", "custom", "out", {"1:00 PM": "noonish", "2:01 PM": "later"}).select("note_id", "out")


def _chain(text: str) -> str:
    for label, pattern in RE2_PATTERNS:
        text = f"regexp_replace({text}, {lit(pattern)}, '[{label}]', 'g')"
    return text


@query("de8_regex_redact", f"WITH {NOTES} SELECT note_id AS id, {_chain('text')} AS out FROM notes UNION ALL SELECT doc_id, {_chain('text')} FROM documents")
def _(spark, sf):
    both = notes(spark, sf).select(col("note_id").alias("id"), "text").unionAll(documents(spark, sf).select("doc_id", "text"))
    return spread(both).select("id", M.regex_redact(col("text")).alias("out"))


KEYWORDS = ["Patient John", "patient", "Dr", "chart"]


@query(
    "de9_keyword_redact",
    f"WITH {NOTES} SELECT note_id, "
    + r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bPatient John\b', '[REDACTED]', 'g'), '(?i)\bpatient\b', '[REDACTED]', 'g'), '(?i)\bchart\b', '[REDACTED]', 'g'), '(?i)\bDr\b', '[REDACTED]', 'g') AS out "
    + f"FROM (SELECT note_id, {_chain('text')} AS t FROM notes)",
)
def _(spark, sf):
    kws = F.array(*[F.lit(k) for k in KEYWORDS])
    return spread(notes(spark, sf)).select("note_id", M.keyword_redact(M.regex_redact(col("text")), kws).alias("out"))


@query("de12_masking_policies", "WITH " + NOTE_SPANS + f", a AS ({sql_replace('notes', 'note_id', 'spans', chr(39) + '<' + chr(39) + ' || label || ' + chr(39) + '>' + chr(39), 'labels')}), b AS ({sql_replace('notes', 'note_id', 'spans', SAME, 'same')}), c AS ({sql_replace('notes', 'note_id', 'spans', chr(39) + '****' + chr(39), 'fixed')}) SELECT note_id, labels, same, fixed FROM a JOIN b USING (note_id) JOIN c USING (note_id)")
def _(spark, sf):
    df = deid.mask(found(spark, sf), "text", "spans", "entity_labels", out="labels")
    df = deid.mask(df, "text", "spans", "same_length_chars", out="same")
    return deid.mask(df, "text", "spans", "fixed_length_chars", 4, out="fixed").select("note_id", "labels", "same", "fixed")


@query("de13_obfuscate", replaced(pool_sql(V.POOLS), names=True))
def _(spark, sf):
    return deid.obfuscate(with_names(spark, sf), "text", "spans", out="out").select("note_id", "out")


REFERENCE = {"NAME": ["Marvin MARSHALL", "Hubert GROGAN", "ALTHEA COLBURN"], "ID": ["111", "222"]}


@query("de13_obfuscate_both", replaced(pool_sql({**V.POOLS, "NAME": V.POOLS["NAME"] + REFERENCE["NAME"], "ID": V.POOLS["ID"] + REFERENCE["ID"]}, 7), names=True))
def _(spark, sf):
    return deid.obfuscate(with_names(spark, sf), "text", "spans", "both", REFERENCE, 7, "out").select("note_id", "out")


POOL_SQL = (
    "pool AS (SELECT 'NAME' AS label, c_name AS value FROM customer UNION SELECT 'ID', p_name FROM part UNION SELECT 'PHONE', '555-' || s_suppkey FROM supplier), "
    "num AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) - 1 AS number, count(*) OVER (PARTITION BY label) AS size FROM pool), sized AS (SELECT DISTINCT label, size FROM num)"
)


def pool(spark, sf):
    """Fake values from the tables: names of customers, numbers of parts, phones made of supplier keys."""
    values = lambda name, label, value: table(spark, sf, name).select(F.lit(label).alias("label"), value.alias("value"))
    return values("customer", "NAME", col("c_name")).unionAll(values("part", "ID", col("p_name"))).unionAll(values("supplier", "PHONE", F.concat(F.lit("555-"), col("s_suppkey").cast("string"))))


@query(
    "de13_obfuscate_from_tables",
    f"WITH {NOTE_SPANS}{NAME_SPANS_SQL}, {POOL_SQL}, named AS (SELECT a.note_id, a.s, a.e, a.txt, a.label, n.value FROM all_spans a LEFT JOIN sized z ON z.label = a.label "
    f"LEFT JOIN num n ON n.label = a.label AND n.number = {index_sql('a.txt', 42, 'z.size')}) " + sql_replace("notes", "note_id", "named", "coalesce(x.value, '[' || label || ']')"),
)
def _(spark, sf):
    return pools.obfuscate_from(with_names(spark, sf), "note_id", "text", "spans", pool(spark, sf), out="out").select("note_id", "out")


@query(
    "de23_columns_from_tables",
    f"WITH {POOL_SQL} SELECT o_orderkey, n.value AS o_clerk FROM (SELECT o_orderkey, 'Clerk ' || (o_custkey % 97) AS clerk FROM orders) o, sized z JOIN num n ON n.label = z.label WHERE z.label = 'NAME' AND n.number = {index_sql('clerk', 5, 'z.size')}",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Clerk "), (col("o_custkey") % 97).cast("string")).alias("o_clerk"))
    return pools.columns_from_pool(orders, {"o_clerk": "NAME"}, pool(spark, sf), {"o_clerk": 5})


MODES = {"obfuscate": ["PHONE"], "mask_entity_labels": ["ID"], "skip": ["DATE"], "mask_same_length_chars": ["NAME"], "mask_fixed_length_chars": ["time"]}


@query("de18_multi_mode", replaced(f"CASE label WHEN 'PHONE' THEN {pool_sql({'PHONE': V.POOLS['PHONE']})} WHEN 'DATE' THEN txt WHEN 'NAME' THEN {SAME} WHEN 'TIME' THEN '****' ELSE '<' || label || '>' END", names=True))
def _(spark, sf):
    return deid.multi_mode(with_names(spark, sf), "text", "spans", MODES, out="out").select("note_id", "out")


@query("de22_multi_output", "WITH " + NOTE_SPANS + f", a AS ({sql_replace('notes', 'note_id', 'spans', chr(39) + '<' + chr(39) + ' || label || ' + chr(39) + '>' + chr(39), 'masked_labels')}), b AS ({sql_replace('notes', 'note_id', 'spans', SAME, 'masked_same_length')}), c AS ({sql_replace('notes', 'note_id', 'spans', chr(39) + '****' + chr(39), 'masked_fixed_length')}), d AS ({sql_replace('notes', 'note_id', 'spans', pool_sql(V.POOLS), 'obfuscated')}) SELECT note_id, masked_labels, masked_same_length, masked_fixed_length, obfuscated FROM a JOIN b USING (note_id) JOIN c USING (note_id) JOIN d USING (note_id)")
def _(spark, sf):
    return deid.all_outputs(found(spark, sf), "text", "spans").select("note_id", "masked_labels", "masked_same_length", "masked_fixed_length", "obfuscated")


@query("de19_keep_part", replaced("CASE WHEN label = 'DATE' AND regexp_matches(txt, '^[0-9]{4}-') THEN txt ELSE '<' || label || '>' END"))
def _(spark, sf):
    """ISO dates are protected as DAY: the rule span wins over the pattern span and is then left out."""
    protected = S.match_spans(col("text"), V.STRUCTURED_PATTERNS[1][1], "DAY")
    spans = pii.merge_chunks(protected, col("spans"), deny=["DAY"])
    return deid.mask(found(spark, sf).withColumn("spans", spans), "text", "spans", out="out").select("note_id", "out")


# ---------------------------------------------------------------- consistent pseudonyms

PSEUDONYM = (
    f"CASE label WHEN 'NAME' THEN ({_list(V.FAKE_FIRST)})[n % 10 + 1] || ' ' || ({_list(V.FAKE_LAST)})[n % 10 + 1] "
    "WHEN 'DATE' THEN lpad(CAST(n % 12 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') || '/XXXX' "
    "WHEN 'PHONE' THEN '555-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '-' || CAST(1000 + n AS VARCHAR) "
    "WHEN 'SSN' THEN 'XXX-XX-XXXX' ELSE '[' || label || '_' || CAST(n AS VARCHAR) || ']' END"
)


@query(
    "de5_strategy_consistent",
    f"WITH {NOTE_SPANS}{NAME_SPANS_SQL}, firsts AS (SELECT label, txt, min(note_id * 100000 + 99999 - s) AS f FROM all_spans GROUP BY label, txt), "
    f"reg AS (SELECT label, txt, row_number() OVER (PARTITION BY label ORDER BY f) AS n FROM firsts), "
    f"numbered AS (SELECT a.*, n FROM all_spans a JOIN reg USING (label, txt)) {sql_replace('notes', 'note_id', 'numbered', PSEUDONYM)}",
)
def _(spark, sf):
    return deid.consistent(with_names(spark, sf), "note_id", "text", "spans", out="out").select("note_id", "out")


@query(
    "wn6_pseudonym_numbering",
    f"WITH {NOTE_SPANS}{NAME_SPANS_SQL}, firsts AS (SELECT label, txt, min(note_id * 100000 + 99999 - s) AS f, count(*) AS n FROM all_spans GROUP BY label, txt) "
    f"SELECT label, txt AS text, n, row_number() OVER (PARTITION BY label ORDER BY f) AS number FROM firsts",
)
def _(spark, sf):
    return deid.pseudonym_registry(with_names(spark, sf), "spans", "note_id").select("label", "text", "n", "number")


@query(
    "de6_consistent_per_document",
    f"WITH {NOTE_SPANS}{NAME_SPANS_SQL}, firsts AS (SELECT note_id, label, txt, max(s) AS f FROM all_spans GROUP BY note_id, label, txt), "
    f"reg AS (SELECT note_id, label, txt, row_number() OVER (PARTITION BY note_id, label ORDER BY f DESC) AS n FROM firsts), "
    f"numbered AS (SELECT a.*, n FROM all_spans a JOIN reg USING (note_id, label, txt)) {sql_replace('notes', 'note_id', 'numbered', PSEUDONYM)}",
)
def _(spark, sf):
    return deid.consistent(with_names(spark, sf), "note_id", "text", "spans", scope="document", out="out").select("note_id", "out")


@query(
    "ag15_replacements_map",
    f"WITH {NOTE_SPANS} SELECT note_id, count(*) AS entries, string_agg(txt || '=' || r, '; ' ORDER BY txt) AS pairs FROM (SELECT DISTINCT note_id, txt, {PLACEHOLDER} AS r FROM spans) GROUP BY note_id",
)
def _(spark, sf):
    df = found(spark, sf).select("note_id", S.replacements_map(col("spans"), M.placeholder).alias("m"))
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.select("note_id", F.size("m").cast("bigint").alias("entries"), F.array_join(pairs, "; ").alias("pairs"))


@query(
    "de20_mapping_table",
    f"WITH {NOTE_SPANS}, r AS (SELECT *, {PLACEHOLDER} AS new FROM spans), g AS (SELECT *, coalesce(sum(length(new) - (e - s)) OVER (PARTITION BY note_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sh FROM r) "
    "SELECT note_id, s AS start, e AS stop, txt AS text, label, new AS replacement, CAST(s + sh AS BIGINT) AS new_start, CAST(s + sh + length(new) AS BIGINT) AS new_stop FROM g",
)
def _(spark, sf):
    df = deid.with_mapping(found(spark, sf), "text", "spans")
    flat = df.select("note_id", F.inline_outer("mapping")).filter(col("start").isNotNull())
    return flat.select(
        "note_id", col("start").cast("bigint").alias("start"), col("end").cast("bigint").alias("stop"), "text", "label", "replacement",
        col("new_start").cast("bigint").alias("new_start"), col("new_end").cast("bigint").alias("new_stop"),
    )


@query("de21_reidentify", f"WITH {NOTES} SELECT note_id AS id, text AS restored FROM notes UNION ALL SELECT doc_id, text FROM documents")
def _(spark, sf):
    both = notes(spark, sf).select(col("note_id").alias("id"), "text").unionAll(documents(spark, sf).select("doc_id", "text"))
    hidden = deid.with_mapping(pii.structured(spread(both), "text"), "text", "spans", "hash").select("id", "deidentified", "mapping")
    return deid.reidentify(hidden).select("id", "restored")


# ---------------------------------------------------------------- dates and ages


def shifted_sql(days: str) -> str:
    us, iso = f"try_strptime(txt, '%m/%d/%Y')", f"try_strptime(txt, '%Y-%m-%d')"
    return (
        f"CASE WHEN label <> 'DATE' THEN txt WHEN regexp_matches(txt, '^\\d{{1,2}}/') THEN strftime({us} + to_days(CAST({days} AS INT)), '%m/%d/%Y') "
        f"ELSE strftime({iso} + to_days(CAST({days} AS INT)), '%Y-%m-%d') END"
    )


DAYS = f"({index_sql('CAST(patient_id AS VARCHAR)', 100, 201)} - 100)"


@query("de15_shift_by_patient", f"WITH {NOTE_SPANS}, sp AS (SELECT s.*, patient_id FROM spans s JOIN notes n ON n.note_id = s.note_id) {sql_replace('notes', 'note_id', 'sp', shifted_sql('x.patient_shift')).replace('FROM sp x', f'FROM (SELECT *, {DAYS} AS patient_shift FROM sp) x')}")
def _(spark, sf):
    df = found(spark, sf)
    return deid.shift_dates(df, "text", "spans", M.patient_shift(col("patient_id"), 100, 100), out="out").select("note_id", "out")


@query("de16_shift_by_column", f"WITH {NOTE_SPANS}, sp AS (SELECT *, note_id % 61 - 30 AS d FROM spans) {sql_replace('notes', 'note_id', 'sp', shifted_sql('x.d'))}")
def _(spark, sf):
    df = found(spark, sf).withColumn("days", (col("note_id") % 61 - 30).cast("string"))
    return deid.shift_dates(df, "text", "spans", col("days"), out="out").select("note_id", "out")


@query(
    "de17_unparsable_dates",
    "SELECT o_orderkey, 'seen ' || CASE o_orderkey % 3 WHEN 0 THEN '<DATE>' WHEN 1 THEN '<DATE>' ELSE strftime(o_orderdate + to_days(5), '%m/%d/%Y') END AS masked, "
    "'seen ' || CASE o_orderkey % 3 WHEN 2 THEN strftime(o_orderdate + to_days(5), '%m/%d/%Y') ELSE "
    f"({_list(V.POOLS['DATE'])})[{index_sql('raw', 42, len(V.POOLS['DATE']))} + 1] END AS faked FROM "
    "(SELECT *, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d %b%Y') ELSE '13/45/' || strftime(o_orderdate, '%Y') END AS raw FROM orders)",
)
def _(spark, sf):
    raw = (
        F.when(col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd MMMyyyy"))
        .when(col("o_orderkey") % 3 == 1, F.concat(F.lit("13/45/"), F.date_format("o_orderdate", "yyyy")))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    )
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("seen "), raw).alias("text"))
    df = df.withColumn("spans", F.array(S.span(F.lit(5), F.length("text"), F.substring(col("text"), 6, 100), F.lit("DATE"), F.lit(1.0))))
    df = deid.shift_dates(df, "text", "spans", F.lit(5), "mask", out="masked")
    return deid.shift_dates(df, "text", "spans", F.lit(5), "obfuscate", out="faked").select("o_orderkey", "masked", "faked")


@query("tx30_shift_date", "SELECT o_orderkey, strftime(o_orderdate + to_days(CAST(o_custkey % 50 - 25 AS INT)), '%m/%d/%Y') AS us, strftime(o_orderdate + to_days(CAST(o_custkey % 50 - 25 AS INT)), '%Y-%m-%d') AS iso FROM orders")
def _(spark, sf):
    days = col("o_custkey") % 50 - 25
    return table(spark, sf, "orders").select(
        "o_orderkey", M.shift_date(F.date_format("o_orderdate", "M/d/yyyy"), days).alias("us"), M.shift_date(F.date_format("o_orderdate", "yyyy-MM-dd"), days).alias("iso")
    )


@query("tx30_written_dates", "SELECT o_orderkey, monthname(d) || ' ' || day(d) || CASE WHEN o_orderkey % 2 = 0 THEN ', ' ELSE ' ' END || year(d) AS shifted FROM (SELECT o_orderkey, o_orderdate + to_days(CAST(o_custkey % 50 - 25 AS INT)) AS d FROM orders)")
def _(spark, sf):
    """Dates with the name of the month, with and without a comma."""
    written = F.when(col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", M.shift_date(written, col("o_custkey") % 50 - 25).alias("shifted"))


def _range_sql(a: str) -> str:
    edges = [0, *V.AGE_RANGES, V.AGE_RANGES[-1] + 40]
    cases = " ".join(f"WHEN {a} > {lo} AND {a} <= {hi} THEN {lo + 1} + {index_sql('CAST(' + a + ' AS VARCHAR)', 42, hi - lo)}" for lo, hi in zip(edges, edges[1:]))
    return f"CASE {cases} ELSE {a} END"


@query(
    "de14_age_policies",
    f"WITH {NOTES}, a AS (SELECT note_id, text, note_id % 80 + 20 AS a FROM notes) SELECT note_id, "
    "regexp_replace(text, 'aged \\d+', 'aged ' || CASE WHEN a < 65 THEN 'adult' ELSE 'senior' END) AS by_group, "
    f"regexp_replace(text, 'aged \\d+', 'aged ' || CAST({_range_sql('a')} AS VARCHAR)) AS by_range, "
    "regexp_replace(text, 'aged \\d+', 'aged ' || CASE WHEN a > 89 THEN '[AGE>89]' ELSE CAST(a AS VARCHAR) END) AS by_limit FROM a",
)
def _(spark, sf):
    ages = pii.context_spans(col("text"), "AGE", r"\d{1,3}", prefix=["aged"], context=6)
    df = spread(notes(spark, sf)).withColumn("spans", ages)
    for policy, out in (("groups", "by_group"), ("ranges", "by_range"), ("hipaa", "by_limit")):
        df = deid.obfuscate_age(df, "text", "spans", policy, out)
    return df.select("note_id", "by_group", "by_range", "by_limit")


# ---------------------------------------------------------------- columns


@query("de23_structured_deid", f"SELECT c_custkey, ({_list(V.POOLS['NAME'])})[{index_sql('c_name', 23, len(V.POOLS['NAME']))} + 1] AS c_name, strftime(DATE '1977-02-13' + to_days(CAST(c_custkey % 3000 + 5 AS INT)), '%d/%m/%Y') AS dob, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", F.date_format(F.date_add(F.lit("1977-02-13").cast("date"), (col("c_custkey") % 3000).cast("int")), "dd/MM/yyyy").alias("dob"), "c_mktsegment")
    return deid.deidentify_columns(df, {"c_name": "NAME", "dob": "DATE"}, {"c_name": 23}, days=5)


@query("de24_complete_mask", "SELECT c_custkey, repeat('#', length(c_name)) AS c_name FROM customer UNION ALL SELECT s_suppkey, repeat('#', length(s_name)) FROM supplier")
def _(spark, sf):
    c = deid.mask_column(table(spark, sf, "customer"), "c_name").select("c_custkey", "c_name")
    return c.unionAll(deid.mask_column(table(spark, sf, "supplier"), "s_name").select("s_suppkey", "s_name"))


@query("de25_partial_mask", "SELECT c_custkey, 'XXXX' || substr(c_name, 5) AS head, left(c_name, length(c_name) - 3) || '***' AS tail, c_name AS none FROM customer")
def _(spark, sf):
    df = deid.mask_column_part(table(spark, sf, "customer"), "c_name", "X", True, 4, "head")
    df = deid.mask_column_part(df, "c_name", "*", False, 3, "tail")
    return deid.mask_column_part(df, "c_name", "*", False, 0, "none").select("c_custkey", "head", "tail", "none")


@query("de26_hash_column", "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def _(spark, sf):
    return deid.hash_column(table(spark, sf, "customer"), "c_name").select("c_custkey", "c_name")


@query("de27_hash_column_salted", "SELECT c_custkey, c_name, sha256(c_name || 'pepper') AS hashed FROM customer")
def _(spark, sf):
    return deid.hash_column(table(spark, sf, "customer"), "c_name", "pepper", "hashed").select("c_custkey", "c_name", "hashed")


# ---------------------------------------------------------------- composed


@query(
    "de28_synthetic_values",
    f"WITH {NOTES}, spans AS ({sql_matches('notes', 'note_id', 'EMAIL_ADDRESS', '[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*[.][A-Za-z]{2,}')}) "
    + sql_replace("notes", "note_id", "spans", f"({_list(V.POOLS['EMAIL'])})[{index_sql('CAST(x.note_id AS VARCHAR) || ' + chr(39) + ':EMAIL_ADDRESS' + chr(39), 42, len(V.POOLS['EMAIL']))} + 1]"),
)
def _(spark, sf):
    df = pii.detect(spread(notes(spark, sf)), "text", ["EMAIL_ADDRESS"])
    return deid.synthesise(df, "note_id", "text", "spans", out="out").select("note_id", "out")


@query(
    "de29_redact_then_analyse",
    f"WITH {NOTES}, t AS (SELECT note_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*[.][A-Za-z]{{2,}}', '[EMAIL_ADDRESS]', 'g'), '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '[US_SSN]', 'g') AS text FROM notes) "
    "SELECT note_id, text, 2 AS entity_count, CAST(len(string_split_regex(trim(text), '\\s+')) AS BIGINT) AS n_words FROM t",
)
def _(spark, sf):
    step = lambda df: df.withColumn("n_words", T.word_count(col("text")).cast("bigint"))
    out = deid.redact_first(spread(notes(spark, sf)).drop("patient_id"), "text", step, ["EMAIL_ADDRESS", "US_SSN"])
    return out.withColumn("entity_count", col("entity_count").cast("bigint")).select("note_id", "text", "entity_count", "n_words")


ROUTED = ["EMAIL_ADDRESS", "IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS", "DATE_TIME", "PHONE_NUMBER"]


ROUTED_WORDS = {"en": [("NRP", "this|that"), ("PERSON", "of the|in the")], "fr": [("NRP", "cette|leurs"), ("PERSON", "de la|dans le")]}


def sql_routed(language: str, first_rank: int) -> str:
    """Spans of the word lists of one language in texts of that language."""
    parts = [sql_matches("routed", "doc_id", label, rf"(?i)\b(?:{words})\b", first_rank) for label, words in ROUTED_WORDS[language]]
    return " UNION ALL ".join(f"SELECT x.* FROM ({p}) x JOIN routed r ON r.doc_id = x.doc_id AND r.language = {lit(language)} WHERE {sql_whole_words('r.text', 'x.s', 'x.e')}" for p in parts)


@query(
    "de30_language_routed_redaction",
    f"WITH routed AS (SELECT doc_id, text, CASE WHEN length(trim(text)) >= 20 AND language = 'en' THEN 'en' ELSE 'fr' END AS language FROM ({LANGUAGE_SQL})), "
    f"{sql_detectors('routed', 'doc_id', ROUTED)}, w AS ({sql_routed('en', 9)} UNION ALL {sql_routed('fr', 9)}), "
    "u AS (SELECT doc_id, s, e, txt, label FROM spans UNION ALL SELECT doc_id, s, e, txt, label FROM w WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = w.doc_id AND w.s < b.e AND b.s < w.e)) "
    + sql_replace("routed", "doc_id", "u", "'[' || label || ']'", "redacted", ", d.language"),
)
def _(spark, sf):
    """Whole texts, redacted by the patterns and by a table of phrases of each language."""
    rows = [(of, p, label) for of, lists in ROUTED_WORDS.items() for label, words in lists for p in words.split("|")]
    phrases = spark.createDataFrame(rows, "language string, phrase string, label string")
    return deid.redact_by_language(spread(documents(spark, sf)), "text", phrases).select("doc_id", "language", "redacted")


# ---------------------------------------------------------------- keywords and entities

LOWER_WORDS = "list_distinct(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 3))"


def keyworded(spark, sf):
    """Notes with their long words as keywords and the place and names as entities."""
    entities = F.concat(S.match_spans(col("text"), SOME_NAMES, "PER"), S.match_spans(col("text"), r"NATION_\d+", "LOC"))
    return spread(notes(spark, sf)).select(
        "note_id", "text", F.filter(T.words(col("text")), lambda w: F.length(w) > 3).alias("keywords"), entities.alias("entities")
    )


ENTITY_SQL = f"list_concat(regexp_extract_all(text, {lit(SOME_NAMES)}), regexp_extract_all(text, 'NATION_\\d+'))"
KEPT_SQL = f"(SELECT note_id, text, list_filter({LOWER_WORDS}, lambda k: len(list_filter({ENTITY_SQL}, lambda e: contains(lower(e), lower(k)) OR contains(lower(k), lower(e)))) > 0) AS kws FROM notes)"


@query("jn4_phrase_overlap_join", f"WITH {NOTES} SELECT note_id, unnest(kws) AS keyword FROM {KEPT_SQL}")
def _(spark, sf):
    kept = deid.keep_overlapping(col("keywords"), F.transform("entities", lambda e: e["text"]))
    return keyworded(spark, sf).select("note_id", F.explode(kept).alias("keyword"))


@query("de11_filter_keywords_by_entities", f"WITH {NOTES} SELECT note_id, CAST(len(kws) AS BIGINT) AS n_kept, array_to_string(list_sort(kws), ' ') AS kept FROM {KEPT_SQL}")
def _(spark, sf):
    kept = deid.keep_overlapping(col("keywords"), F.transform("entities", lambda e: e["text"]))
    df = keyworded(spark, sf).select("note_id", kept.alias("k"))
    return df.select("note_id", F.size("k").cast("bigint").alias("n_kept"), F.array_join(F.array_sort("k"), " ").alias("kept"))


@query(
    "de10_keyword_highlight",
    f"WITH {NOTES}, {sql_structured('notes', 'note_id')}, pt AS ({sql_matches('notes', 'note_id', 'keyword', '(?i)' + chr(92) + 'b(?:NATION_[0-9]+)' + chr(92) + 'b')}), "
    f"nm AS ({sql_matches('notes', 'note_id', 'entity', SOME_NAMES)}), u AS (SELECT note_id, s, e, txt, 'regex' AS label FROM spans UNION ALL SELECT note_id, s, e, txt, label FROM pt UNION ALL SELECT note_id, s, e, txt, label FROM nm) "
    + sql_replace("notes", "note_id", "u", "CASE label WHEN 'regex' THEN '<r>' || txt || '</r>' WHEN 'keyword' THEN '<k>' || txt || '</k>' ELSE '<e>' || txt || '</e>' END"),
)
def _(spark, sf):
    df = keyworded(spark, sf).withColumn("regex", pii.structured_spans(col("text")))
    layers = deid.highlight_layers(col("text"), col("regex"), F.regexp_extract_all("text", F.lit(r"NATION_\d+"), F.lit(0)), col("entities"))
    marks = {"regex": ("<r>", "</r>"), "keyword": ("<k>", "</k>"), "entity": ("<e>", "</e>")}
    return df.select("note_id", "text", layers.alias("layers")).select("note_id", deid.highlight(col("text"), col("layers"), marks).alias("out"))
