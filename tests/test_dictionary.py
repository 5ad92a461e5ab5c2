"""Dictionary entities against a plain search, over one shard and over many."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textspark.operators import deid, dictionary, pii

WORD = re.compile(r"[^\W](?:[\w#'’-]*\w)?")


def plain(text, phrases, language=None):
    """Every run of whole words that is a phrase, as (start, end, label)."""
    words = [m.span() for m in WORD.finditer(text or "")]
    out = set()
    for i, (s, _) in enumerate(words):
        for _, e in words[i : i + 14]:
            for phrase, label, of in phrases:
                if text[s:e].lower() == phrase and (of is None or language is None or of == language):
                    out.add((s, e, label))
    return out


def random_rows(n=120):
    rng = random.Random(5)
    vocabulary = ["new", "york", "bank", "of", "o'neil", "été", "st-jean", "straße", "x1", "_id", "日本", "nord", "the", "#tag", "a"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", "-", "  ", "\n", "’"]) for _ in range(k))
    texts = [text(rng.randrange(40)) for _ in range(n)]
    phrases = {" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 1, 2, 2, 3, 12]))) for _ in range(90)} | {"new york", "york bank", "new york bank of", "a"}
    runs = [t[m.start() : m.start() + 60].rstrip().lower() for t in texts[:20] if (m := WORD.search(t))]
    rows = [(p, rng.choice(["PERSON", "LOCATION", "NRP"]), rng.choice([None, "en", "fr"])) for p in sorted(phrases | set(runs)) if p]
    rows += [(rows[0][0], "OTHER", None), rows[1], ("", "EMPTY", None), (None, "NULL", None), ("nolabel", None, None)]
    return [(i, t.upper() if i % 3 == 0 else t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)] + [(900, None, "en"), (901, "", "fr")], rows


@pytest.mark.parametrize("size", [(1_000_000, 10_000_000), (25, 10_000_000), (1_000_000, 300)])
@pytest.mark.parametrize("by_language", [False, True])
def test_spans_equal_a_plain_search(spark, monkeypatch, size, by_language):
    texts, phrases = random_rows()
    docs = spark.createDataFrame([(*t, "p") for t in texts], "id long, t string, language string, phrase string").repartition(3)
    table = spark.createDataFrame(phrases, "phrase string, label string, language string")
    split = dictionary.shards
    monkeypatch.setattr(dictionary, "shards", lambda rows: split(rows, *size))
    assert (len(dictionary.shards(table)) > 2) == (size != (1_000_000, 10_000_000))
    found = pii.gazetteer_spans(docs, "id", "t", table, "language" if by_language else None).collect()
    known = [p for p in phrases if p[0] and p[1]]
    want = {(i, *s) for i, t, of in texts for s in plain(t, [(p, l, o if by_language else None) for p, l, o in known if not by_language or o is None or o == of], None)}
    assert {(r["id"], r["start"], r["end"], r["label"]) for r in found} == want and len(found) == len(want)
    by_id = {i: t for i, t, _ in texts}
    assert all(r["text"] == by_id[r["id"]][r["start"] : r["end"]] for r in found)
    rows = dictionary.with_dictionary_spans(docs, "t", table, "language" if by_language else None, "s", "id").collect()
    assert sorted((r["id"], r["phrase"]) for r in rows) == sorted((t[0], "p") for t in texts)
    assert {(r["id"], s["start"], s["end"], s["label"]) for r in rows for s in r["s"]} == want
    for r in rows:
        spans = [(s["start"], -s["end"], s["label"]) for s in r["s"]]
        assert spans == sorted(spans)


def test_many_shards_need_a_key(spark, monkeypatch):
    texts, phrases = random_rows(3)
    split = dictionary.shards
    monkeypatch.setattr(dictionary, "shards", lambda rows: split(rows, 25, 10**7))
    docs = spark.createDataFrame(texts, "id long, t string, language string")
    with pytest.raises(ValueError, match="needs the key"):
        dictionary.with_dictionary_spans(docs, "t", spark.createDataFrame(phrases, "phrase string, label string, language string"))


def test_one_call_for_patterns_and_names(spark):
    docs = spark.createDataFrame([(1, "Anna Lee of New York City, Roma, wrote to a.lee@new.york on 2020-01-02."), (2, None), (3, "")], "id long, t string")
    table = spark.createDataFrame([("anna lee", "PERSON"), ("lee", "PERSON"), ("new york", "LOCATION"), ("new york city", "LOCATION"), ("city", "PERSON"), ("roma", "NRP"), ("roma", "LOCATION"), ("york", "LOCATION")], "phrase string, label string")
    labels = lambda entities: {r["id"]: [(s["text"], s["label"]) for s in r["spans"]] for r in pii.detect(docs, "t", entities, dictionary=table).collect()}
    got = labels(["PERSON", "LOCATION", "NRP", "EMAIL_ADDRESS", "DATE_TIME"])
    assert got == {1: [("Anna Lee", "PERSON"), ("New York", "LOCATION"), ("City", "PERSON"), ("Roma", "LOCATION"), ("lee", "PERSON"), ("york", "LOCATION"), ("2020-01-02", "DATE_TIME")], 2: [], 3: []}
    got = labels(["EMAIL_ADDRESS", "NRP", "LOCATION", "PERSON", "DATE_TIME"])
    assert got[1] == [("Anna Lee", "PERSON"), ("New York City", "LOCATION"), ("Roma", "NRP"), ("a.lee@new.york", "EMAIL_ADDRESS"), ("2020-01-02", "DATE_TIME")]
    assert labels(None)[1] == [("Anna Lee", "PERSON"), ("New York City", "LOCATION"), ("Roma", "LOCATION"), ("a.lee@new.york", "EMAIL_ADDRESS"), ("2020-01-02", "DATE_TIME")]
    with pytest.raises(ValueError, match="PERSON"):
        pii.detect(docs, "t", ["PERSON", "EMAIL_ADDRESS"])


def test_texts_use_the_dictionary_of_their_language(spark):
    docs = spark.createDataFrame(
        [(1, "the boss of that Quebecer is at x@y.org and the rest of us"), (2, "le patron est un Quebecer de la ville avec x@y.org"), (3, "Quebecer"), (4, "  "), (5, None), (6, "der Quebecer ist nicht in der Stadt und das ist gut")],
        "id long, t string",
    )
    table = spark.createDataFrame([("en", "quebecer", "NRP"), ("fr", "patron", "PERSON"), (None, "stadt", "LOCATION")], "language string, phrase string, label string")
    got = {r["id"]: (r["language"], r["redacted"]) for r in deid.redact_by_language(docs, "t", table).collect()}
    assert got[1] == ("en", "the boss of that [NRP] is at [EMAIL_ADDRESS] and the rest of us")
    assert got[2] == ("fr", "le [PERSON] est un Quebecer de la ville avec [EMAIL_ADDRESS]")
    assert got[3] == ("fr", "Quebecer") and got[4] == ("fr", "  ") and got[5] == ("fr", None)
    assert got[6] == ("fr", "der Quebecer ist nicht in der [LOCATION] und das ist gut")
    lists = {"en": {"NRP": ["Quebecer"]}, "fr": {"PERSON": ["patron"]}}
    assert {r["id"]: r["redacted"] for r in deid.redact_by_language(docs, "t", lists).collect()}[1] == got[1][1]


def test_no_phrases_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a text")], "id long, t string")
    none = spark.createDataFrame([], "phrase string, label string")
    assert pii.gazetteer_spans(docs, "id", "t", none).collect() == []
    assert pii.detect(docs, "t", ["PERSON"], dictionary=none).first()["spans"] == []
    assert pii.gazetteer_spans(docs.limit(0), "id", "t", spark.createDataFrame([("a", "X")], "phrase string, label string")).collect() == []


def test_text_is_not_shuffled(spark):
    docs = spark.range(5).select("id", F.lit("new york").alias("t"))
    table = spark.createDataFrame([("new york", "LOCATION")], "phrase string, label string")
    plan = pii.detect(docs, "t", dictionary=table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
