"""Ranked search, source audit and byte-level BPE against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from textspark.llm import byte_bpe, lexical_search, source_audit

# ---------------------------------------------------------------- search


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 12), st.integers(1, 4), st.integers(0, 10**6))
def test_sequential_reads_find_the_best(size, n_lists, k, depth, seed):
    rng = random.Random(seed)
    lists, score = [], Counter()
    for _ in range(n_lists):
        docs = rng.sample(range(size), rng.randrange(size + 1))
        rows = sorted(((rng.randrange(1, 5), d) for d in docs), key=lambda x: (-x[0], x[1]))
        lists.append((np.array([d for _, d in rows], np.int32), np.array([i for i, _ in rows], np.int64)))
        for i, d in rows:
            score[d] += i
    best, scores, read = lexical_search.nra(lists, k, size, depth)
    want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert list(zip(best.tolist(), scores.tolist(), strict=True)) == want
    assert read <= sum(len(d) for d, _ in lists)


def test_reads_stop_early():
    n = 20_000
    lists = [(np.arange(n, dtype=np.int32), np.arange(n, 0, -1).astype(np.int64)) for _ in range(3)]
    best, _, read = lexical_search.nra(lists, 10, n)
    assert best.tolist() == list(range(10)) and read < 3000


def plain_search(rows, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(d, Counter(term.findall(lower(t)))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall(lower(t)))
    out = []
    for item, words in asked.items():
        scored = []
        for d, c in docs:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search_equals_a_plain_one(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 300)
    monkeypatch.setattr(lexical_search, "BLOCK", 400)
    rng = random.Random(3)
    items = [(i, prose(rng, 1 + 3 * i)) for i in range(12)] + [(12, None), (13, ""), (14, "日本 ÉCOLE"), (None, "rivers"), (15, "absent-everywhere"), (3, "cloud window"), (3, "cloud window"), (16, "WORD"), (17, odd_rows[3][1])]
    table = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, score string, rank int")
    got = lexical_search.ranked(odd_docs, table).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(plain_search([(r[0], r[1]) for r in odd_rows], items), key=key)
    assert sorted([tuple(r) for r in got], key=key) == want
    assert len(want) > 90


def test_search_of_nothing(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert lexical_search.ranked(no_docs, items).collect() == []
    assert lexical_search.ranked(odd_docs, items.limit(0)).collect() == []
    assert lexical_search.ranked(odd_docs, items).columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------- audit


def plain_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [(lang or "", source or "", Counter(term.findall(lower(text or "")))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(w for r in mine for w in r[2])
        kept = sorted(w for w in df if df[w] >= least)

        def shares(of, kept=kept):
            c = sum((r[2] for r in of), Counter())
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}, c

        q = shares(mine)[0]
        p = {s: shares([r for r in mine if r[1] == s]) for s in {r[1] for r in mine}}
        for s in p:
            pair = [(o, sum(abs(p[s][0][w] - p[o][0][w]) for w in kept)) for o in p if o != s]
            terms = [(w, p[s][0][w] - q[w]) for w in kept if p[s][1][w] and p[s][0][w] > q[w]]
            for part, found, n in (("pair", pair, len(pair)), ("term", terms, top)):
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n], 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    rows = []
    for i in range(200):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None])
        text = rng.choice([prose(rng, rng.randrange(60)), "same River text. " * 3, "ünï ß-stone", "", None, "12 34"])
        rows += [(lang, source, text)] * rng.choice([1, 1, 1, 4])
    return rows + [("fr", "only", "unseen words"), ("it", "x", "one"), ("it", "y", None), (None, "zz", None)]


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_audit_equals_a_plain_one(spark, monkeypatch, held):
    monkeypatch.setattr(source_audit, "HELD", held)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, rank int").repartition(5)
    got = source_audit.divergence(docs, least=6, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 6, 7)


def test_tasks_hand_on_sums_early(spark):
    rows = spark.createDataFrame([("en", "a b a", [("s", 2), ("t", 1)])], "lang string, text string, owners array<struct<source: string, n: long>>")
    got = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in source_audit.term_counts(rows).collect()}
    assert got == {("s", "a"): (4, 2), ("s", "b"): (2, 2), ("t", "a"): (2, 1), ("t", "b"): (1, 1)}


def test_audit_of_nothing_and_large_counts(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    assert source_audit.divergence(no_docs.withColumn("source", F.lit("s"))).collect() == []
    big = spark.range(1).select(source_audit.share(F.lit(10**13 - 5), F.lit(3 * 10**13 - 10), F.lit(2)).alias("p")).first()["p"]
    assert big == 1 + 10**9 // 3


def test_one_text_is_cut_once(spark):
    rows = [("en", s, "same text") for s in "aabbbc"] + [("en", "a", None), ("de", "a", "same text")]
    got = source_audit.collapsed(spark.createDataFrame(rows, "lang string, source string, text string").repartition(4), "lang", "source", "text")
    found = {(r["lang"], r["text"]): {o["source"]: o["n"] for o in r["owners"]} for r in got.collect()}
    assert found == {("en", "same text"): {"a": 2, "b": 3, "c": 1}, ("en", ""): {"a": 1}, ("de", "same text"): {"a": 1}}


# ---------------------------------------------------------------- bytes to ids and back


def odd_texts():
    rng = random.Random(11)
    texts = [None, "", " ", "\n\n  \t", "a", "it's we'll they'RE 'tis '' ''' don't", "  two  spaces   three\n\n\nlines \n x" * 9, "x" * 700, " " * 700, "日本語" * 200,
             "é😀 \x00 <|endoftext|> " * 30, "1234567890" * 40, "   a\u0085b " * 40, "!?" * 300, "ab \n" * 120]
    parts = ["a", "b's", " ", "  ", "\n", "'re", "'", "ll", "7", "é", "😀", "\t", "!", "wordword", " ", "'v", "e"]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(60)]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (64, 64), (1 << 15, 1 << 10)])
def test_chunks_give_the_ids_of_the_whole_text(spark, chunk, overlap):
    texts = odd_texts()
    texts += texts[5:8]
    rows = spark.createDataFrame([(i if i % 7 else None, t, "x", "y", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, chunk string, `row` int").repartition(3)
    whole = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encoding
    found = byte_bpe.decoded(byte_bpe.encoded(rows, chunk=chunk, overlap=overlap))
    assert found.columns == ["doc_id", "text", "chunk", "row", "ids", "decoded"]
    got = found.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i if i % 7 else None, t) for i, t in enumerate(texts))
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_a_long_text_is_cut_into_pieces(spark):
    rng = random.Random(2)
    text = prose(rng, 40_000)
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = byte_bpe.encoded(rows).first()["ids"]
    whole = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encoding
    assert np.frombuffer(got, "<u4").tolist() == whole.encode_ordinary(text) and len(text) > 5 * byte_bpe.CHUNK


def test_pieces_end_where_neighbours_agree():
    at = lambda *x: np.array(x, np.int64)
    assert byte_bpe.stitch(at(40, 42, 44), at(41, 42, 44), "abcd efgh", 40) == 44  # before white space first
    assert byte_bpe.stitch(at(40, 42), at(41, 42), "abcdefgh", 40) == 42
    assert byte_bpe.stitch(at(42), at(42), "a  b", 40) == -1  # white space before it
    assert byte_bpe.stitch(at(41), at(42), "abcd", 40) == -1


def test_digests_of_the_query(spark, tmp_path):
    texts = odd_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encoding
    got = byte_bpe.op13(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = whole.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_texts(no_docs):
    assert byte_bpe.decoded(byte_bpe.encoded(no_docs)).collect() == []
