import random
import time
import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textspark.functions import masks as M
from textspark.functions import spans as S
from textspark.functions import text as T
from textspark.operators import deid, pii
from textspark.resources import values as V

SENTENCES = [
    ("Referral for Nora Blake, date of birth 1962-09-17, seen at the Lakeside clinic on 2023-02-08 for a cough.",
     "Referral for Nora Blake, date of birth [DATE], seen at the Lakeside clinic on [DATE] for a cough."),
    ("The file of Owen Hart lists SSN 219-45-1177 and an address on Birch Road.", "The file of Owen Hart lists SSN [SSN] and an address on Birch Road."),
    ("Iris Vale accepted the lease on August 3 2021 in the presence of two neighbours.", "Iris Vale accepted the lease on [DATE] in the presence of two neighbours."),
    ("Shift lead Tom Reyes (employee ID K-7731) closed ticket #TK-00418 on 06/14/2022 at 7:20 AM.", "Shift lead Tom Reyes (employee ID [ID]) closed ticket #[ID] on [DATE] at [TIME]."),
    ("Order #ORD-2021-37 goes to 8 Harbour Lane, Halifax, NS B3J 2K9.", "Order #[ID] goes to 8 Harbour Lane, Halifax, NS [POSTAL_CODE]."),
    ("Phone (212) 555-0198 or 212-555-0198 or +1-877-555-0198.", "Phone [PHONE] or [PHONE] or [PHONE]."),
]


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


def spans_of(*rows):
    return F.array(*[S.span(F.lit(a), F.lit(b), F.lit(t), F.lit(k), F.lit(c)) for a, b, t, k, c in rows])


def short(found):
    return [(s.start, s.end, s.label) for s in found]


def test_regex_redact(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "i int, t string")
    out = [r.x for r in df.orderBy("i").select(M.regex_redact(F.col("t")).alias("x")).collect()]
    assert out == [s[1] for s in SENTENCES]


def test_span_offsets_match_python(spark):
    texts = [s[0] for s in SENTENCES] + ["é 2024-11-01 naïve 😀 2023-01-02 end", "", "none", "1-2 " * 900 + "2024-11-01 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", S.match_spans(F.col("t"), V.STRUCTURED_PATTERNS[1][1], "DATE").alias("s")).collect()}
    for i, text in enumerate(texts):
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\b\d{4}-\d{2}-\d{2}\b", text)]
        assert [(s.start, s.end, s.text) for s in got[i]] == want


def test_later_pattern_inside_earlier_span_is_dropped(spark):
    # 2024-11-01 contains nothing else; the phone lies outside the SSN
    found = one(spark, "123-45-6789 and 416-555-0123", pii.structured_spans)
    assert short(found) == [(0, 11, "SSN"), (16, 28, "PHONE")]


@pytest.mark.parametrize(
    "strategy, expected",
    [
        ("placeholder", "Patient [NAME] was admitted."),
        ("redact", "Patient ██████████ was admitted."),
        ("hash", f"Patient [NAME_{hashlib.sha256(b'John Smith').hexdigest()[:8]}] was admitted."),
        ("entity_labels", "Patient <NAME> was admitted."),
        ("same_length_chars", "Patient [********] was admitted."),
    ],
)
def test_strategies(spark, strategy, expected):
    text = "Patient John Smith was admitted."
    df = spark.createDataFrame([(1, text)], "k long, t string").withColumn("s", spans_of((8, 18, "John Smith", "NAME", 1.0)))
    assert deid.deidentify(df, "t", "s", strategy, "o").first().o == expected
    assert deid.consistent(df, "k", "t", "s", scope="document", out="o").first().o == "Patient Jane Johnson was admitted."
    assert deid.consistent(df, "k", "t", "s", out="o").first().o == "Patient Jane Johnson was admitted."


def test_unknown_strategy(spark):
    df = spark.createDataFrame([("a",)], "t string").withColumn("s", S.no_spans())
    with pytest.raises(ValueError):
        deid.deidentify(df, "t", "s", "nonsense")


def test_pseudonym_formulas(spark):
    kinds = ["NAME", "DATE", "PHONE", "EMAIL", "SSN", "MRN", "LOCATION", "AGE", "URL"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    out = {r.k: r.v for r in df.select("k", M.pseudonym(F.col("k"), F.lit(1)).alias("v")).collect()}
    assert out == {
        "NAME": "Jane Johnson", "DATE": "02/02/XXXX", "PHONE": "555-001-1001", "EMAIL": "johnson1@example.com", "SSN": "XXX-XX-XXXX",
        "MRN": "MRN-00000001", "LOCATION": "[LOCATION_1]", "AGE": "[AGE>89]", "URL": "[URL_1]",
    }


def test_merge_adjacent(spark):
    found = one(spark, "abcd efghi 12-3", lambda t: S.merge_adjacent(t, spans_of((0, 4, "", "NAME", 0.5), (5, 10, "", "NAME", 0.9), (11, 15, "", "DATE", 1.0))))
    assert short(found) == [(0, 10, "NAME"), (11, 15, "DATE")] and found[0].text == "abcd efghi" and found[0].confidence == 0.9


def test_provider(spark):
    def label(text, a, b):
        return one(spark, text, lambda t: pii.promote_provider(t, spans_of((a, b, "x", "NAME", 1.0))))[0].label

    assert label("Dr. Ann Lee saw", 4, 11) == "PROVIDER"
    assert label("saw Ann Lee, MD here", 4, 11) == "PROVIDER"
    assert label("saw Ann Lee here", 4, 11) == "NAME"


def test_iob(spark):
    tags = F.array(*[F.lit(x) for x in ["B-PER", "I-PER", "O", "I-LOC", "B-LOC", "I-PER"]])
    found = one(spark, "John Smith in New York Bob", lambda t: pii.iob_to_spans(S.match_spans(t, r"\S+", "w"), tags))
    assert [(s.text, s.label) for s in found] == [("John Smith", "PER"), ("New", "LOC"), ("York", "LOC"), ("Bob", "PER")]


def test_context_rules(spark):
    years = lambda t: pii.context_spans(t, "YEAR", "[12][0-9]{3}")
    text = "Case 9180274. She moved to the coast in 2005. The roof is due for repair in 2025."
    assert [s.text for s in one(spark, text, years)] == ["2005", "2025"]
    rule = lambda t: pii.context_spans(
        t, "test_result", r"\d{2}.?\d{2}.?\d{2}|\d{2}.?\d{2}.?\d{4}|\d{2}.?\d", prefix=["Wedge", "RHC", "LHC", "PA", "RV"], context=45,
        exceptions=["born", "on"], exception_distance=10,
    )
    text = "Ada Flint was born 07-12-1981. She turned 40. Values: RHC 11-22-33, LHC 11\\22\\33, Wedge 11-16-1972."
    assert [s.text for s in one(spark, text, rule)] == ["11-22-33", "11\\22\\33", "11-16-1972"]


def test_year_is_kept(spark):
    text = "seen in 2005 by us"
    year = lambda t: pii.context_spans(t, "YEAR", "[12][0-9]{3}")
    model = spans_of((8, 12, "2005", "DATE", 0.9), (16, 18, "us", "NAME", 0.9))
    assert short(one(spark, text, lambda t: pii.merge_chunks(year(t), model, deny=["YEAR"]))) == [(16, 18, "NAME")]


def test_dates(spark):
    rows = [("10/02/2022", "10", "10/12/2022"), ("03/01/2020", "-2", "02/28/2020"), ("2020-03-01", "-1", "2020-02-29"), ("03 Apr2022", "1", None), ("13/45/2022", "1", None)]
    df = spark.createDataFrame(rows, "t string, d string, want string")
    out = df.select(M.shift_date(F.col("t"), F.col("d")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]
    shifts = spark.range(500).select(M.patient_shift(F.col("id"), 100, 100).alias("s"))
    low, high, n = shifts.agg(F.min("s"), F.max("s"), F.count_distinct("s")).first()
    assert -100 <= low < -80 and 80 < high <= 100 and n > 150


def test_ages(spark):
    df = spark.createDataFrame([("1 year old",), ("17",), ("aged 55",), ("92 years",), ("unknown",)], "t string")
    out = df.select(M.age_group(F.col("t")).alias("g"), M.age_in_range(F.col("t")).alias("r"), M.age_hipaa(F.col("t")).alias("h")).collect()
    assert [r.g for r in out] == ["toddler", "teenager", "adult", "senior", "unknown"]
    assert [r.h for r in out] == ["1 year old", "17", "aged 55", "[AGE>89]", "unknown"]
    ages = [int(re.search(r"\d+", r.r).group()) for r in out[:4]]
    assert ages[0] == 1 and 12 < ages[1] <= 20 and 40 < ages[2] <= 60 and 80 < ages[3] <= 120


def test_structured_columns(spark):
    df = spark.createDataFrame([("Juan García", "13/02/1977", "711 Nulla St."), (None, "bad", "x")], "NAME string, DOB string, ADDRESS string")
    out = deid.deidentify_columns(df, {"NAME": "NAME", "DOB": "DATE"}, {"NAME": 23}, days=5).collect()
    assert out[0].DOB == "18/02/1977" and out[0].NAME in V.POOLS["NAME"] and out[0].ADDRESS == "711 Nulla St."
    assert out[1].NAME is None and out[1].DOB == "<DATE>"


def test_column_masks(spark):
    assert one(spark, "Anna", lambda t: M.mask_all(t)) == "####"
    assert one(spark, "1990-05-01", lambda t: M.mask_part(t, "X", True, 4)) == "XXXX-05-01"
    assert one(spark, "abc", lambda t: M.mask_part(t, "*", False, 0)) == "abc"
    assert one(spark, "abc", lambda t: M.mask_part(t, "*", False, 9)) == "***"
    assert one(spark, "a", lambda t: M.hash_text(t, "pepper")) == hashlib.sha256(b"apepper").hexdigest()


def test_keywords(spark):
    kws = lambda *k: F.array(*[F.lit(x) for x in k])
    assert one(spark, "John Smith met JOHN.", lambda t: M.keyword_redact(t, kws("John", "John Smith"))) == "[REDACTED] met [REDACTED]."
    assert one(spark, "a+b (x) c.d", lambda t: M.keyword_redact(t, kws("a+b", "c.d"))) == "[REDACTED] (x) [REDACTED]"
    kept = one(spark, "", lambda t: deid.keep_overlapping(kws("john", "chest pain", "York", "john"), kws("John Smith", "New York City")))
    assert kept == ["john", "York"]
    layers = one(
        spark, "On 2024-11-01 John saw Acme",
        lambda t: deid.highlight_layers(t, pii.structured_spans(t), kws("john", "saw"), F.concat(S.match_spans(t, "John", "PER"), S.match_spans(t, "Acme", "ORG"))),
    )
    assert [(s.text, s.label) for s in layers] == [("2024-11-01", "regex"), ("John", "keyword"), ("Acme", "entity")]


def test_pools(spark):
    pools = M.merge_pools("both", {"NAME": ["Will Perry"], "CITY": ["Aberdeen"]})
    assert pools["NAME"][-1] == "Will Perry" and pools["CITY"] == ["Aberdeen"] and "Will Perry" not in V.POOLS["NAME"]
    assert M.merge_pools("file", {"X": ["y"]}) == {"X": ["y"]}
    with pytest.raises(ValueError):
        M.merge_pools("other")


def test_redact_first_hides_the_original(spark):
    df = spark.createDataFrame([(1, "mail a@b.org"), (2, None)], "k long, t string")
    seen = []
    out = deid.redact_first(df, "t", lambda d: seen.append(d.columns) or d, ["EMAIL_ADDRESS"]).orderBy("k").collect()
    assert seen == [["k", "t", "entity_count"]] and out[0].t == "mail [EMAIL_ADDRESS]" and out[1].t is None


def test_card_checksum(spark):
    good, bad = "4000 0000 0000 0002", "4000 0000 0000 0003"
    assert [s.text for s in one(spark, f"{good} and {bad}", lambda t: pii.detector_spans(t, ["CREDIT_CARD"]))] == [good]
    assert len(one(spark, f"{good} and {bad}", lambda t: pii.detector_spans(t, ["CREDIT_CARD"], check_cards=False))) == 2


def test_validate_types():
    assert pii.validate_types(["name", "Date"]) == ["NAME", "DATE"]
    with pytest.raises(ValueError):
        pii.validate_types(["nothing"])


def test_reference_file(spark, tmp_path):
    path = tmp_path / "ref.txt"
    path.write_text("Marvin MARSHALL#PATIENT\nEkaterina Rosa#DOCTOR\nInci FOUNTAIN#PATIENT\n")
    assert deid.read_reference(spark, str(path)) == {"DOCTOR": ["Ekaterina Rosa"], "PATIENT": ["Inci FOUNTAIN", "Marvin MARSHALL"]}


# ---------------------------------------------------------------- properties

PIECES = ["123-45-6789", "2024-11-01", "09/22/2024", "3:45 PM", "V6B 1A1", "416-555-0123", "E-4892", "word", "é", " ", ", ", "x", "\n", "12"]
TEXTS = st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map(" ".join), min_size=1, max_size=12)
SETTINGS = settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(texts=TEXTS)
def test_round_trip_and_lengths(spark, texts):
    df = pii.structured(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "s")
    df = deid.with_mapping(df, "t", "s", "hash")
    df = deid.reidentify(deid.mask(df, "t", "s", "same_length_chars", out="same"))
    for r in df.collect():
        assert r.restored == r.t
        assert len(r.same) == len(r.t)
        assert all(a.end <= b.start for a, b in zip(r.s, r.s[1:]))


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from(["A", "B"])), min_size=1, max_size=8))
def test_merge_is_idempotent_and_order_free(spark, rows):
    text = "x" * 60
    data = [(i, a, a + n, k) for i, (a, n, k) in enumerate(rows)]

    def merged(order):
        arr = spans_of(*[(a, b, text[a:b], k, 1.0) for _, a, b, k in order])
        out = one(spark, text, lambda t: S.merge_adjacent(t, F.array_sort(arr)))
        return sorted(short(out)), one(spark, text, lambda t: S.merge_adjacent(t, S.merge_adjacent(t, F.array_sort(arr))))

    first, twice = merged(data)
    assert first == merged(list(reversed(data)))[0]
    assert sorted(short(twice)) == first


@SETTINGS
@given(texts=TEXTS)
def test_consistent_is_a_function_whatever_the_partitions(spark, texts):
    rows = list(enumerate(texts))
    outs = []
    for parts in (1, 7):
        df = pii.structured(spark.createDataFrame(rows, "k long, t string").repartition(parts), "t", "s")
        outs.append({r.k: r.o for r in deid.consistent(df, "k", "t", "s", out="o").select("k", "o").collect()})
    assert outs[0] == outs[1]
    df = pii.structured(spark.createDataFrame(rows, "k long, t string"), "t", "s")
    registry = deid.pseudonym_registry(df, "s", "k").collect()
    # brute force: documents in order, spans from right to left
    numbers, want = {}, {}
    for k, spans in sorted((r.k, r.s) for r in df.select("k", "s").collect()):
        for s in sorted(spans, key=lambda s: -s.start):
            if (s.label, s.text) not in want:
                numbers[s.label] = numbers.get(s.label, 0) + 1
                want[(s.label, s.text)] = numbers[s.label]
    assert {(r.label, r.text): r.number for r in registry} == want


def test_ngram_counts(spark):
    for m in range(0, 7):
        arr = F.array(*[F.lit(str(i)) for i in range(m)]).cast("array<string>")
        out = one(spark, "", lambda t: T.ngrams(arr, 3))
        assert len(out) == {0: 0, 1: 1, 2: 3}.get(m, 3 * m - 3)
    assert one(spark, "", lambda t: T.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 3)) == ["a", "b", "c", "a_b", "b_c", "a_b_c"]




def test_many_spans_in_one_document(spark):
    n = 20_000
    row = spark.range(1).select(F.lit("x" * (4 * n)).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: S.span(i * 4, i * 4 + 2, F.concat(F.lit("v"), (i % 700).cast("string")), F.lit("ID"), F.lit(1.0))).alias("s"))
    out = deid.consistent(row, "t", "t", "s", scope="document").first().deidentified
    assert out.startswith("[ID_") and len(set(re.findall(r"ID_[0-9]+", out))) == 700


def test_phrases_of_many_words(spark):
    docs = spark.createDataFrame([(1, "He banked at bank of new york mellon, downtown.")], "id long, t string")
    phrases = spark.createDataFrame([("bank of new york mellon", "ORG"), ("downtown", "PLACE")], "phrase string, label string")
    found = pii.gazetteer_spans(docs, "id", "t", phrases).collect()
    assert sorted((r.text, r.label) for r in found) == [("bank of new york mellon", "ORG"), ("downtown", "PLACE")]


def test_chunks_of_tags_are_those_of_a_walk(spark):
    """Random tags, null ones, null tokens and arrays of unequal length against one step a token."""
    rng = random.Random(8)
    rows = [(0, None, ["O"]), (1, [], []), (2, [(0, 1, "a", 0.5)], None)]
    for d in range(3, 120):
        n = rng.randrange(1, 14)
        toks = [None if rng.random() < 0.05 else (2 * i, 2 * i + 1, rng.choice(["x", "y", None]), rng.choice([0.25, 0.5, None])) for i in range(n)]
        rows.append((d, toks, [rng.choice(["O", "B-A", "I-A", "I-A", "I-B", "B-B", "B", None]) for _ in range(max(0, n + rng.randrange(-1, 2)))]))
    df = spark.createDataFrame(rows, "id long, toks array<struct<start int, end int, text string, confidence double>>, tags array<string>")
    label = lambda t: t if t is None or t[:2] not in ("B-", "I-") else t[2:]
    for r in df.select("id", "toks", "tags", pii.iob_to_spans(F.col("toks"), F.col("tags")).alias("found")).collect():
        if r["toks"] is None or r["tags"] is None:
            assert r["found"] is None
            continue
        want, going = [], False
        for i in range(max(len(r["toks"]), len(r["tags"]))):
            t, tag = (x[i] if i < len(x) else None for x in (r["toks"], r["tags"]))
            start, end, text, score = t or (None,) * 4
            if tag == "O":
                going = False
            elif tag and tag[:2] == "I-" and going and want[-1][3] == label(tag):
                last = want.pop()
                least = [x for x in (last[4], score) if x is not None]
                want.append((last[0], end, " ".join(x for x in (last[2], text) if x is not None), last[3], min(least, default=None)))
            else:
                want.append((start, end, text, label(tag), score))
                going = True
        assert [tuple(x) for x in r["found"]] == want, r


def test_chunks_take_time_in_proportion(spark):
    """One text of 60,000 chunks; as many copies of a growing array took minutes."""
    n = 60_000
    toks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("start"), (i + 1).alias("end"), F.lit("w").alias("text"), F.lit(1.0).alias("confidence")))
    df = spark.range(1).select(toks.alias("toks"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.lit("B-A")).alias("tags"))
    begun = time.monotonic()
    assert df.select(F.size(pii.iob_to_spans(F.col("toks"), F.col("tags"))).alias("n")).first()["n"] == n
    assert time.monotonic() - begun < 20
