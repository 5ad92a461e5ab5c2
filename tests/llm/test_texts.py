import math
import datetime
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tests.llm.conftest import prose
from textspark.llm import decontaminate, packing, pseudonyms, quality_classifier, token_counts, toxicity


def fold_of(doc_id, folds):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


# ---------------------------------------------------------------- pseudonyms


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 256, 1000])
def test_feistel_is_a_permutation(size):
    image = [pseudonyms.feistel(x, size, b"k", "t") for x in range(size)]
    assert sorted(image) == list(range(size))
    assert [pseudonyms.feistel(y, size, b"k", "t", reverse=True) for y in image] == list(range(size))
    assert size < 10 or image != [pseudonyms.feistel(x, size, b"other", "t") for x in range(size)]


VALUES = [
    ("mail", "ann.lee7@site.example"), ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("date", "2024-02-29"), ("date", "31.12.1999"),
    ("date", "02/29/2024"), ("date", "25/03/1980"), ("social", "219-09-9999"), ("address", "10.0.255.1"), ("phone", "+1 (212) 555-0147"), ("phone", "(212) 555-0147"), ("secret", 'token = "0a9f3c77aa10"'), ("secret", "password: Xy-12abCD9"),
]


@pytest.mark.parametrize("kind,value", VALUES)
def test_pseudonyms_keep_the_format(kind, value):
    text = f"see {value}, or {value}."
    new, kinds = pseudonyms.pseudonymise(text, "key")
    assert kinds == [kind, kind] and value not in new
    first, second = new[4:-1].split(", or ")
    assert first == second
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    if kind not in ("address", "secret"):
        assert shape(first) == shape(value)
    assert pseudonyms.pseudonymise(new, "key", reverse=True) == (text, kinds)
    assert pseudonyms.pseudonymise(new, "key")[1] == kinds  # still valid
    assert pseudonyms.pseudonymise(text, "another")[0] != new


def test_one_value_however_written():
    new = pseudonyms.pseudonymise("4111111111111111 4111-1111-1111-1111 A.B@x.org a.b@X.org 2001-05-06 06.05.2001", "k")[0].split(" ")
    assert new[0] == new[1].replace("-", "") and new[2].lower() == new[3].lower()
    assert new[4] == "-".join(reversed(new[5].split(".")))


@pytest.mark.parametrize("value", ["4111111111111112", "2023-02-29", "45.13.2000", "256.1.1.1", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "1.2.3.4.5", "version 1.2", "12345", "a@b", "1899-01-01"])
def test_what_is_not_valid_stays(value):
    assert pseudonyms.pseudonymise(f"x {value} y", "k") == (f"x {value} y", [])


@pytest.mark.parametrize(("before", "value", "after"), [
    ("", "4111 1111 1111 1111", " 123"), ("", "4111 1111 1111 1111", " 12/25"), ("order 12 ", "4111 1111 1111 1111", ""), ("12 34 56 78 ", "4111-1111-1111-1111", "-99 x"),
    ("", "ES91 2100 0418 4502 0005 1332", " OK"), ("", "BE68 5390 0754 7034", " EUR"), ("AB12 ", "BE68 5390 0754 7034", " TOTAL DUE 1234"), ("call ", "+49 (30) 1234 5678", " 9012 3456"),
])
def test_valid_values_beside_other_groups(before, value, after):
    alone, kinds = pseudonyms.pseudonymise(value, "k")
    assert len(kinds) == 1 and alone != value
    new, found = pseudonyms.pseudonymise(before + value + after, "k")
    assert (new, found) == (before + alone + after, kinds)


def test_dates_are_permuted_among_all_days():
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(0, 73_000, 37)]
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
        new = [pseudonyms.pseudonymise(d.strftime(form), "k")[0] for d in days]
        assert len(set(new)) == len(days) and all(1900 <= datetime.datetime.strptime(x, form).year <= 2099 for x in new)


def test_pseudonyms_of_a_table(odd_docs, no_docs):
    for found in (None, "kinds"):
        out = pseudonyms.with_pseudonyms(odd_docs, "k", found=found)
        assert out.columns == odd_docs.columns + ([found] if found else [])
        assert sorted(map(str, out.select(odd_docs.columns).collect())) == sorted(map(str, odd_docs.collect()))  # nothing personal there
    values = odd_docs.withColumn("text", F.when(F.col("doc_id") < 5, F.concat("text", F.lit(" a.b@c.org 10.1.1.1"))).otherwise(F.col("text")))
    new = [r["text"] for r in pseudonyms.with_pseudonyms(values, "k").where("doc_id < 5").collect()]
    assert len({t[-26:].split(" ", 1)[1] for t in new}) == 1 and not any("a.b@c.org" in t or "10.1.1.1" in t.split() for t in new)
    assert pseudonyms.with_pseudonyms(no_docs, "k").collect() == []


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def unigram():
    return token_counts.Unigram.load(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_equal_a_unigram_tokenizer(unigram):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    low = min(unigram.pieces.values())
    vocabulary = [(p.id_to_piece(i), p.get_score(i) if p.id_to_piece(i) in unigram.pieces else low) for i in range(p.get_piece_size())]
    plain = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    rng = random.Random(5)
    texts = [prose(rng, 50) for _ in range(50)] + ["".join(rng.choice("ab  eth\n日本é😀\x00.x▁") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    for t in texts:
        assert unigram.count(t)[0] == len(plain.encode("▁" + t.replace(" ", "▁")).ids), t


def plain_viterbi(pieces, unknown, text):
    """Best score and, of equal ones, the count with the earliest starts."""
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            s = pieces.get(text[start:end], unknown if end - start == 1 else None)
            if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                best[end] = best[start][0] + s, best[start][1] + (1 if text[start:end] in pieces else len(text[start:end].encode()))
    return best[-1]


def test_ties_go_to_the_earliest_start():
    rng = random.Random(8)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): -float(rng.randrange(1, 4)) for _ in range(8)}
        model = token_counts.Unigram(pieces)
        for _ in range(10):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            count, _, score = model.best(text)
            assert (score, count) == plain_viterbi(pieces, model.unknown, text)


def test_pieces_across_blanks_are_seen():
    model = token_counts.Unigram({"▁a": -1.0, "▁b": -1.0, "▁a▁b": -1.5})
    assert model.count("a b") == (1, 0) and model.count("b a") == (2, 0)


def test_counts_of_a_table(odd_docs, odd_rows, no_docs, unigram):
    got = sorted((str(r["doc_id"]), r["n_pieces"]) for r in token_counts.counted(odd_docs).collect())
    assert got == sorted((str(d), unigram.count(t or "")[0]) for d, t, _ in odd_rows)
    assert ("30", 0) in got and ("31", 0) in got
    assert token_counts.counted(no_docs).collect() == []


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert(points, bits)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def plain_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("span", [1 << 23, 3000])
def test_pieces_hold_each_id_once(odd_docs, odd_rows, monkeypatch, span):
    monkeypatch.setattr(packing, "RANGE", span)
    rows = packing.packed(odd_docs).collect()
    ids = {d: np.array(plain_ids(t), "<u4") for d, t, _ in odd_rows}
    copies, sequences = {}, {}
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["ids"] == x[r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(x)
        copies.setdefault(r["doc_id"], np.zeros(len(x), int))[r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, n in copies.items():
        assert (n == sum(i == d for i, _, _ in odd_rows)).all()
    assert set(copies) == set(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert span > 3000 or len({s >> 32 for s in sequences}) > 2


def test_words_are_encoded_as_in_whole_texts():
    t = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's CAFÉ é 12ab- x <|endoftext|>", "日本 語\x0b\x0c\x1c x y", "", "İΣ ς Ⅻ ﬁ"]
    assert [x.tolist() for x in t.encode([s.encode() for s in texts])] == [plain_ids(s) for s in texts]


def test_nothing_is_packed_of_nothing(no_docs):
    assert packing.packed(no_docs).collect() == []


# ---------------------------------------------------------------- decontamination


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(77)
    items = [(i, " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(15 + 2 * i))) for i in range(20)]
    items += [(100, None), (101, ""), (102, "too short"), (3, items[3][1])]
    return spark.createDataFrame(items, "item_id long, text string"), {i: t for i, t in items if t and len(t.split()) >= 8}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_leaks_are_found_and_nothing_else(spark, odd_docs, bench):
    table, items = bench
    rng = random.Random(6)
    planted, rows = {}, []
    for i, t in items.items():
        words = t.split()
        for kind in range(3):
            w = list(words)
            if kind:  # a word in eight replaced, or words put in between
                for at in range(3, len(w), 8):
                    w[at : at + 2 - kind] = ["other"]
            doc = 2000 + 10 * i + kind
            planted[doc] = i
            text = " ".join([prose(rng, rng.randrange(80)), " ".join(w).upper() if kind == 0 else ", ".join(w), prose(rng, 50)])
            rows.append((doc, text))
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.leaks(docs, table).collect()}
    assert set(found) == set(planted.items())
    by = dict(rows)
    for (d, i), share in list(found.items())[:15]:
        assert share <= plain_lcs(decontaminate.word_list(items[i].encode()), decontaminate.word_list(by[d].encode())) / len(items[i].split()) + 1e-9
    clean = decontaminate.clean(docs, table)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r["doc_id"]) for r in odd_docs.collect())


def test_candidates_are_not_lost(spark, bench, monkeypatch):
    """Windows near by cosine against every window as a candidate: recall of leaks on documents of its own kind."""
    table, items = bench
    rng = random.Random(12)
    syllables = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    texts = [syllables(rng.randrange(20, 300)) for _ in range(300)]
    for i, t in items.items():
        for every in (3, 4, 5, 8):  # so many words have one replaced
            w = t.split()
            for at in range(i % every, len(w), every):
                w[at] = syllables(1)
            texts.append(" ".join([syllables(rng.randrange(100)), *w, syllables(rng.randrange(100))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, n = decontaminate.passage_counts(docs)
    idf = np.log((n + 1) / (counts + 1)).astype(np.float32)
    pieces = decontaminate.Items(list(items.items()), decontaminate.directions(docs, table.where("length(text) > 9"), idf) * idf[:, None], idf)
    bodies = [t.encode() for t in texts]
    found = {(m[0], pieces.ids[m[1]]) for m in decontaminate.matches(pieces, bodies)}
    monkeypatch.setattr(decontaminate, "NEAR", -2.0)
    every = {(m[0], pieces.ids[m[1]]) for m in decontaminate.matches(pieces, bodies)}
    assert found <= every and len(every) > 50
    assert len(found) >= 0.9 * len(every), (len(found), len(every))


def test_candidates_are_not_lost_by_a_cut_sample(spark, bench, monkeypatch):
    """The same recall with directions from 64 passages of the corpus and as many of the benchmark."""
    monkeypatch.setattr(decontaminate, "SAMPLE", 64)
    test_candidates_are_not_lost(spark, bench, monkeypatch)


@pytest.mark.parametrize("together", [1 << 14, 7])
def test_directions_are_those_of_all_passages(spark, monkeypatch, together):
    """The subspace of a plain iteration over every passage of every text, whatever is multiplied at once."""
    monkeypatch.setattr(decontaminate, "SAMPLE", together)
    rng = random.Random(21)
    make = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts, items = [make(rng.randrange(60, 130)) for _ in range(32)] + [None, "", "w1 w1 w1"], [make(20 * i) for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [[], []]
    for of, bodies in zip(rows, (texts, items), strict=True):
        for t in bodies:
            s = decontaminate.slots(decontaminate.word_list((t or "").encode()))
            of += [np.bincount(s[i : i + decontaminate.PASSAGE], minlength=decontaminate.SLOTS) for i in range(0, len(s), decontaminate.PASSAGE)]
    counts, n = decontaminate.passage_counts(docs)
    assert n == len(rows[0]) and counts.tolist() == (np.array(rows[0]) > 0).sum(0).tolist()
    idf = np.log((n + 1) / (counts + 1)).astype(np.float32)
    a = np.array(rows[0] + rows[1]) * idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert decontaminate.RANK < len(a) < decontaminate.PER_SKIP
    plain = np.linalg.qr(np.random.default_rng(5).standard_normal((decontaminate.SLOTS, decontaminate.RANK)))[0]
    for _ in range(decontaminate.STEPS):
        plain = np.linalg.qr(a.T @ (a @ plain))[0]
    found = decontaminate.directions(docs, table, idf)
    assert found.shape == plain.shape
    assert (np.square(found.T @ plain).sum(0) > 0.999).all()


def test_short_items_are_phrases(spark):
    table = spark.createDataFrame([(1, "Red, river"), (2, "stone"), (3, "red river"), (4, "...")], "item_id long, text string")
    texts = ["a red river.", "RED-RIVER", "red wide river", "redriver", "a stone", "stones", "", None, "red red river bank stone red river"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["first_word"], r["share"]) for r in decontaminate.leaks(docs, table).collect())
    assert got == [(0, 1, 1, 1.0), (0, 3, 1, 1.0), (1, 1, 0, 1.0), (1, 3, 0, 1.0), (4, 2, 1, 1.0), (8, 1, 1, 1.0), (8, 2, 4, 1.0), (8, 3, 1, 1.0)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, table).orderBy("doc_id").collect()] == [2, 3, 5, 6, 7]


def test_subsequence_equals_the_plain_one():
    rng = random.Random(3)
    idf = np.ones(decontaminate.SLOTS, np.float32)
    for _ in range(200):
        piece = [rng.choice("abcdef") for _ in range(rng.randrange(8, 20))]
        items = decontaminate.Items([(1, " ".join(piece))], np.zeros((decontaminate.SLOTS, 2), np.float32), idf)
        other = [rng.choice("abcdefgh").encode() for _ in range(rng.randrange(30))]
        assert items.match(other, 0)[0] == pytest.approx(plain_lcs([w.encode() for w in piece], other) / len(piece))


def test_no_benchmark_and_no_documents(spark, odd_docs, no_docs, bench):
    empty = bench[0].limit(0)
    assert decontaminate.leaks(odd_docs, empty).collect() == [] and decontaminate.leaks(no_docs, bench[0]).collect() == []
    assert decontaminate.clean(odd_docs, empty).count() == odd_docs.count() and decontaminate.clean(no_docs, bench[0]).collect() == []


# ---------------------------------------------------------------- classifiers


def test_toxic_words_are_learnt_and_folded(spark):
    rng = random.Random(12)
    bad = ["grumblefink", "snarkwad"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, "You GRUMBLEF1NK, snаrkw@d"), (1001, "the snarkwad bird song"), (1002, None), (1003, ""), (None, "grumblefink grumblefink"), (1004, prose(rng, 20_000))]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, 0), (None, 1), (5000, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.classified(docs, known, "toxic", 4, 2, exceptions=("snarkwad bird",)).collect()}
    assert len(out) == len(rows)
    for i, toxic in labels:
        assert out[i]["held_out"] == (fold_of(i, 4) == 2) and out[i]["predicted"] == toxic
    assert out[1000]["predicted"] == 1 and len(out[1000]["matched"]) == 2 and out[None]["predicted"] == 1 and not out[None]["held_out"]
    assert out[1001]["matched"] == [] and all(out[i]["predicted"] == 0 for i in (1001, 1002, 1003, 1004))
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_scores_are_those_of_all_labels_whatever_the_sample(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        toxic = i % 12 == 0
        words = prose(rng, 40).split()
        for _ in range(2 * toxic + (rng.random() < 0.04)):
            words.insert(rng.randrange(len(words)), "grumblefink")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = {r["doc_id"]: r["score"] for r in toxicity.classified(docs, docs, "toxic", 4, 2).collect()}
    monkeypatch.setattr(toxicity, "SAMPLE", 70)
    part = {r["doc_id"]: r["score"] for r in toxicity.classified(docs, docs, "toxic", 4, 2).collect()}
    odds = [math.log(part[i] / (1 - part[i])) - math.log(whole[i] / (1 - whole[i])) for i, _, y in rows if not y]
    assert abs(sum(odds) / len(odds)) < 1.0  # unweighted classes shift them by the log of eleven


def test_folding():
    assert toxicity.folded("Y0u 1diot! Іdiоt tr@sh, $cum$$$ 1234 (É)") == " you idiot idiot trash scum e "
    assert toxicity.folded("") == "  "


def test_quality_by_two_gaussians(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, prose(rng, 80) if good else " ".join(f"{w}{rng.choice(['###', '%%', '***'])}" for w in prose(rng, 80).split())))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, prose(rng, 90)), (1002, prose(rng, 20_000)), (1003, rows[1][1])]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_classifier.classified(docs, known, "quality", 5, 0).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["held_out"] == (fold_of(i, 5) == 0) for i, _ in labels)
    held = [(out[i]["predicted"], y) for i, y in labels if out[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[1003]["score"] == out[1]["score"] and not out[None]["held_out"]


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(2)
    k = len(quality_classifier.STATISTICS)
    data = {0: rng.normal(0, 1, (200, k)), 1: rng.normal(0.5, 2, (300, k))}
    model = quality_classifier.Discriminant({c: (float(len(x)), x.sum(0), x.T @ x) for c, x in data.items()})
    pooled = sum(len(x) / 500 * np.cov(x.T, bias=True) for x in data.values())
    density = {}
    x = rng.normal(0, 2, (20, k))
    for c, d in data.items():
        s = 0.9 * np.cov(d.T, bias=True) + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(k)
        z = x - d.mean(0)
        density[c] = np.log(len(d) / 500) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z)
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(density[0] - density[1])))


def test_classifiers_without_labels_or_rows(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, toxic int, quality int")
    for labels, quality in ((none, 0.5), (one, 1.0)):
        assert {r["score"] for r in toxicity.classified(odd_docs, labels, "toxic", 4, 2).collect()} == {0.5}
        assert {r["score"] for r in quality_classifier.classified(odd_docs, labels, "quality", 5, 7).collect()} == {quality}
    assert toxicity.classified(no_docs, one, "toxic", 4, 2).collect() == [] == quality_classifier.classified(no_docs, one, "quality", 5, 0).collect()


def test_words_are_cut_as_arrays_and_each_part_is_learned_once(monkeypatch):
    t = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    letters = "abYZ09'’<|%,. \n\x0b\x00\u0085\u00a0éÖßİŞΣσς日本ǅ½٣²e\u0301\u0915\u093f\u1100\u1161가한😀𝔄«—"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "<|endoftext|> a<|b", "it's we'LL 'tis", "ΟΔΟΣ Σ"]
    want = [[*t.tokenizer.encode(x, add_special_tokens=False).ids, packing.END] for x in texts]
    assert [x.tolist() for x in t.encode([x.encode() for x in texts])] == want
    monkeypatch.setattr(packing, "PIECE", 7)
    monkeypatch.setattr(packing, "CACHE", 20)
    assert [x.tolist() for x in t.encode([x.encode() for x in texts])] == want
    again = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    again.encode([b"River, river. RIVER; (river) river"])
    assert set(again.known) == {"river", ",", ".", ";", "(", ")"}
