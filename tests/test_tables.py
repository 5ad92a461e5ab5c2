import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textspark.functions import scores as SC
from textspark.functions import text as T
from textspark.operators import anomaly, classify, corpus, filters, keywords, scale, sentiment, topics
from textspark.plans import jobs
from textspark.resources import values as V
from textspark.sources import readers, writers


def docs(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "a cat and a dog"), (4, "")]
    return spark.createDataFrame(rows, "id long, text string").withColumn("tokens", T.words(F.col("text")))


# ---------------------------------------------------------------- scale helpers


def skewed(spark):
    """A third of all rows share one key."""
    return spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))


def test_lookup_paths_agree(spark):
    fact = skewed(spark)
    dim = fact.groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.length("key")).filter("key <> 'k7'")
    small = {(r.id, r.value) for r in scale.lookup(fact, dim, ["key"], F.col("id")).collect()}
    salted = {(r.id, r.value) for r in scale.lookup(fact, dim, ["key"], F.col("id"), rows=1).collect()}
    assert small == salted and len(small) == 900


def test_counted_lookup_paths_agree(spark, monkeypatch):
    fact = skewed(spark)
    dim = fact.groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.length("key")).filter("key <> 'k7'")
    small = {(r.id, r.value) for r in scale.counted_lookup(fact, dim, ["key"], "n", F.col("id")).collect()}
    monkeypatch.setattr(scale, "fits", lambda df, rows=0: False)
    split = scale.counted_lookup(fact, dim, ["key"], "n", F.col("id"), hot=100)
    assert {(r.id, r.value) for r in split.collect()} == small and len(small) == 900
    assert split.columns == ["id", "key", "n", "value"]


def test_positions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10)).alias("v")).repartition(5)
    rows = scale.global_position(df, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(((r.id, r.v) for r in rows), key=lambda x: (-x[1], x[0]))
    assert [i for i, _ in want] == [r.id for r in sorted(rows, key=lambda r: r.position)]
    assert sorted(r.position for r in rows) == list(range(1, 1001))
    grouped = scale.grouped_position(df, ["g"], [F.col("v"), F.col("id")]).collect()
    for g in range(7):
        part = sorted((r for r in grouped if r.g == g), key=lambda r: r.position)
        assert [r.position for r in part] == list(range(1, len(part) + 1))
        assert [(r.v, r.id) for r in part] == sorted((r.v, r.id) for r in part)


def test_exact_quantiles(spark):
    df = spark.range(501).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("v"))
    pdf = df.toPandas()
    out = {(r.g, r.prob): r.quantile for r in scale.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0], ["g"]).collect()}
    for (g, p), q in out.items():
        assert q == pytest.approx(np.quantile(pdf[pdf.g == g].v, p))
    assert scale.exact_quantiles(df, "v", [0.5]).first().quantile == pytest.approx(pdf.v.median())


def test_checkpoint_dir_comes_from_the_session(spark):
    df = scale.checkpointed(spark.range(3))
    assert df.count() == 3 and spark.sparkContext.getCheckpointDir()


# ---------------------------------------------------------------- sources and filters


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).dtypes == [("a", "string"), ("b", "string")]
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), infer=True).dtypes[0] == ("a", "int")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx y\n")
    assert readers.read_csv(spark, str(tmp_path / "t.tsv"), infer=True, sep="\t").first().b == "x y"
    (tmp_path / "l.txt").write_text(" one \n\n  \ntwo\n")
    assert [r.text for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["one", "two"]
    (tmp_path / "lab.txt").write_text("1 good  film\n0 bad\n\n")
    lab = readers.read_labelled(spark, str(tmp_path / "lab.txt"))
    assert [(r.label, r.tokens) for r in lab.collect()] == [(1, ["good", "film"]), (0, ["bad"])]
    assert readers.max_length(lab).first().max_length == 2
    files = tmp_path / "files" / "sub"
    files.mkdir(parents=True)
    (files / "n.txt").write_text("line one\nline two")
    (files / "empty.txt").write_text("")
    got = readers.read_files(spark, str(tmp_path / "files")).collect()
    assert [(r.file.split("/")[-1], r.text) for r in got] == [("n.txt", "line one\nline two")]
    (tmp_path / "req").mkdir()
    (tmp_path / "req" / "r.json").write_text('{"body": "{\\"data\\": [{\\"patient_id\\": \\"P1\\", \\"text\\": \\"hi\\"}]}"}')
    for name, broken in (("x", "not json"), ("y", '{"data": []}'), ("z", '{"body": "no"}')):
        (tmp_path / "req" / f"{name}.json").write_text(broken)
    records, errors = readers.read_record_batch(spark, str(tmp_path / "req"))
    assert [tuple(r)[1:] for r in records.collect()] == [(0, "P1", "hi")]
    assert sorted((r.file.split("/")[-1], r.error) for r in errors.collect()) == [(f"{n}.json", "no records") for n in "xyz"]


def test_columns(spark):
    df = spark.createDataFrame([(1, None)], "` a ` int, b string")
    assert readers.find_column(df, "a") == " a " and readers.find_column(df, "b") == "b"
    with pytest.raises(ValueError, match="available"):
        readers.find_column(df, "zz")
    with pytest.raises(ValueError, match="missing"):
        readers.require(df, ["b", "c"])
    assert [tuple(r) for r in readers.canonicalise(df, {"a": "A"}).collect()] == [("1", "")]


def test_writers(spark, tmp_path):
    df = docs(spark).select("id", "text")
    base = str(tmp_path / "out")
    writers.write_many({"x": df, "y": df.limit(1)}, base)
    assert spark.read.parquet(f"{base}/x").count() == 4 and readers.read_docs(spark, f"{base}/y").count() == 1
    writers.write(df, f"{base}/c", "csv")
    assert spark.read.option("header", True).csv(f"{base}/c").count() == 4
    writers.write(df, f"{base}/j", "json")
    assert spark.read.json(f"{base}/j").count() == 4
    files = spark.createDataFrame([("file:/a/note.txt", "x\ny"), ("file:/a/b", "z"), ("file:/a/c/note.txt", "w")], "file string, text string")
    writers.write_mirrored(files, f"{base}/m", root="file:/a")
    names = {(r.folder, r.name): r.value for r in spark.read.text(f"{base}/m", wholetext=True).collect()}
    assert names == {(None, "note_deidentified.txt"): "x\ny\n", (None, "b_deidentified"): "z\n", ("c", "note_deidentified.txt"): "w\n"}


def test_filters(spark):
    df = docs(spark)
    assert filters.guard_corpus(df, 2) is df
    with pytest.raises(ValueError):
        filters.guard_corpus(df, 30)
    with pytest.raises(ValueError):
        filters.guard_corpus(df, 2, docs=(2, 3))
    assert filters.guard_corpus(spark.range(2000), 2).count() == 2000
    with pytest.raises(ValueError):
        filters.guard_corpus(df.limit(2), 2, embedding=True)
    ok, bad = filters.route(df, filters.record_problem("id", "text"))
    assert ok.count() == 3 and bad.first().error == "empty text"
    assert filters.sample_rows(df, 2).count() == 2
    rows = filters.slice_rows(spark.range(50).repartition(3), [F.desc("id")], 3, 5).orderBy("position").collect()
    assert [(r.position, r.id) for r in rows] == [(3, 46), (4, 45)]


def test_language(spark):
    df = spark.createDataFrame([("the cat is on the mat",), ("le chat est dans la maison",), ("der Hund ist nicht im Haus",), ("short",), ("zzz qqq www xxx",)], "t string")
    assert [r.x for r in df.select(T.detect_language(F.col("t")).alias("x")).collect()] == ["en", "fr", "de", "unknown", "unknown"]


# ---------------------------------------------------------------- small expressions


def test_scores(spark):
    row = spark.range(1).select(
        SC.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"),
        SC.argmax_label(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), ["a", "b", "c"]).alias("m"),
        SC.align(F.create_map(F.lit("POSITIVE"), F.lit(0.9)), V.LABEL_SETS["binary"]).alias("a"),
    ).first()
    assert row.s == [0.5, 0.5] and row.m == "b" and row.a == [0.0, 0.9]
    cuts = spark.createDataFrame([(0.05,), (0.049,), (-0.05,)], "c double").select(SC.polarity_label(F.col("c")).alias("l"))
    assert [r.l for r in cuts.collect()] == ["positive", "neutral", "negative"]
    assert [r.n for r in spark.createDataFrame([("  two words ",), (None,)], "t string").select(T.word_count(F.col("t")).alias("n")).collect()] == [2, 0]
    tags = F.array(F.lit("JJ_NN"), F.lit("NN_VB"), F.lit("JJ_NN_NN"))
    assert spark.range(1).select(T.filter_pos_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), tags).alias("k")).first().k == ["a", "c"]


def test_sentences_have_exact_offsets(spark):
    text = "First one. Second? Third é!  Tail without end\nnext"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentence_spans(F.col("t")).alias("s")).first().s
    assert [s.text for s in got] == ["First one.", "Second?", "Third é!", "Tail without end\nnext"]
    assert all(text[s.start : s.end] == s.text for s in got)


# ---------------------------------------------------------------- corpus


def test_collocations(spark):
    rows = [(1, ["new", "york", "is", "big"]), (2, ["new", "york", "new", "york"]), (3, ["a", "new", "york", "day"]), (4, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    pairs = corpus.collocations(df, "tokens", 2, 1.0)
    ones, twos = Counter(t for _, ts in rows for t in ts), Counter(p for _, ts in rows for p in zip(ts, ts[1:]))
    size = len(ones) + len(twos)
    want = {p: (n - 2) * size / ones[p[0]] / ones[p[1]] for p, n in twos.items() if n >= 2}
    assert {(r.a, r.b): pytest.approx(r.score) for r in pairs.collect()} == {p: s for p, s in want.items() if s > 1.0}
    out = {r.id: r.phrases for r in corpus.join_collocations(df, "id", "tokens", pairs).collect()}
    assert out == {1: ["new_york", "is", "big"], 2: ["new_york", "new_york"], 3: ["a", "new_york", "day"], 4: []}


def test_encodings(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["b", "c"]), (3, [])], "id long, tokens array<string>")
    vocab = corpus.training_vocab(df, "tokens", min_count=1)
    assert {r.term: r.id for r in vocab.collect()} == {"<pad>": 0, "<unk>": 1, "<s>": 2, "</s>": 3, "b": 4, "c": 5, "a": 6}
    ids = corpus.encode(df, "id", "tokens", vocab.filter("term <> 'c'"))
    assert {r.id: r.ids for r in ids.collect()} == {1: [4, 6, 4], 2: [4, 1], 3: []}
    sized = spark.createDataFrame([(i, [1] * n) for i, n in enumerate([2, 2, 3, 5, 5, 7])], "id long, ids array<int>")
    out = {r.id: (r.bucket, r.padded) for r in corpus.length_buckets(sized, "ids", 2).collect()}
    assert out[0] == (2, [1, 1]) and out[2] == (5, [1, 1, 1, 0, 0]) and out[5] == (None, None)


def test_lemmas(spark):
    lines = spark.createDataFrame([("run->running\tran",), ("good->better",), ("junk",)], "value string")
    table = corpus.parse_lemmas(lines)
    df = spark.createDataFrame([(1, ["he", "ran", "running", "better"])], "id long, tokens array<string>")
    assert corpus.lemmatise(df, "id", "tokens", table).first().lemmas == ["he", "run", "run", "good"]
    assert corpus.lemmatise(df, "id", "tokens", table, distinct=True).first().lemmas == ["he", "run", "good"]


def test_topic_terms_job(spark):
    df = spark.createDataFrame([(1, "The happy runner walks quickly in a beautiful garden")], "id long, text string")
    row = jobs.topic_terms(df, "id", "text").first()
    assert "garden" in row.unigrams and "the" not in row.unigrams and "beautiful_garden" in row.final


def test_redact_columns_job(spark):
    df = spark.createDataFrame([(1, "a@b.org", "x", "call 416-555-0123")], "id long, a string, m string, b string")
    out = jobs.redact_columns(df, ["a", "b"])
    assert out.columns == ["id", "a", "redacted_a", "m", "b", "redacted_b"]
    assert tuple(out.first()) == (1, "a@b.org", "[EMAIL_ADDRESS]", "x", "call 416-555-0123", "call [PHONE_NUMBER]")


# ---------------------------------------------------------------- sentiment


def test_polarity_rules(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("great", 3.1)], "word string, valence double")
    texts = ["good", "not good", "very good", "VERY good", "GOOD day", "good!!!", "bad but great", "not very good", "extremely bad", "nothing known", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {r.id: r for r in sentiment.polarity(df, "id", "t", lexicon).collect()}
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    want = [1.9, 1.9 * -0.74, 1.9 + 0.293, 1.9 + 0.293 + 0.733, 1.9 + 0.733, 1.9 + 3 * 0.292, -2.5 * 0.5 + 3.1 * 1.5, (1.9 + 0.293) * -0.74, -2.5 - 0.293]
    for i, s in enumerate(want):
        assert out[i].compound == norm(s), texts[i]
    assert (out[9].compound, out[9].neu) == (0.0, 1.0)
    assert (out[10].compound, out[10].neu) == (0.0, 0.0)
    assert (out[11].compound, out[11].pos, out[11].neg, out[11].neu) == (0.0, 0.0, 0.0, 1.0)
    for r in out.values():
        assert r.pos + r.neg + r.neu == pytest.approx(0 if r.id == 10 else 1, abs=0.002)


def test_polarity_without_broadcast_is_the_same(spark, monkeypatch):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    df = spark.createDataFrame([(i, "good bad good " * (i % 4)) for i in range(40)], "id int, t string")
    one = {tuple(r) for r in sentiment.polarity(df, "id", "t", lexicon).collect()}
    monkeypatch.setattr(scale, "fits", lambda df, rows=0: False)
    assert {tuple(r) for r in sentiment.polarity(df, "id", "t", lexicon).collect()} == one


def test_dictionary_sentiment(spark):
    words = spark.createDataFrame([("good", "positive"), ("bad", "negative")], "word string, label string")
    df = spark.createDataFrame([(1, "Plain start. A bad day. A good one."), (2, "good bad"), (3, "nothing")], "id int, t string")
    assert {r.id: r.sentiment for r in sentiment.dictionary_sentiment(df, "id", "t", words).collect()} == {1: "negative", 2: "positive", 3: "na"}


# ---------------------------------------------------------------- keywords against brute force


def brute_yake(text, window, stops):
    import re

    sents = [m.group() for m in re.finditer(r"(?s)(?=\S).*?(?:[.!?](?=\s)|\Z)", text)]
    toks = [[w for w in re.findall(r"\w+", s)] for s in sents]
    occ, left, right = {}, {}, {}
    for si, ws in enumerate(toks):
        for i, w in enumerate(ws):
            low = w.lower()
            occ.setdefault(low, []).append((si, i, w))
            left.setdefault(low, []).extend(x.lower() for x in ws[max(0, i - window) : i])
            right.setdefault(low, []).extend(x.lower() for x in ws[i + 1 : i + 1 + window])
    usable = {w for w in occ if w not in stops and len(w) > 2 and not w[0].isdigit()}
    tfs = [len(occ[w]) for w in usable]
    mean, std, top = np.mean(tfs), np.std(tfs), max(len(o) for o in occ.values())
    score = {}
    for w in usable:
        o, tf = occ[w], len(occ[w])
        upper = sum(1 for _, i, x in o if x[0].isupper() and i > 0)
        acro = sum(1 for _, _, x in o if x.isupper() and len(x) > 1)
        rel = 1 + sum(len(set(c)) / len(c) if c else 0 for c in (left[w], right[w])) * tf / top
        case, pos = max(upper, acro) / (1 + math.log(tf)), math.log(math.log(3 + np.median([s for s, _, _ in o])))
        freq, sent = tf / (mean + std), len({s for s, _, _ in o}) / len(toks)
        score[w] = rel * pos / (case + freq / rel + sent / rel)
    found = {}
    for ws in toks:
        lows = [w.lower() for w in ws]
        for n in (1, 2, 3):
            for i in range(len(lows) - n + 1):
                part = lows[i : i + n]
                if all(p in usable for p in part):
                    found.setdefault(" ".join(part), []).append(part)
    return {k: math.prod(score[p] for p in v[0]) / (len(v) * (1 + sum(score[p] for p in v[0]))) for k, v in found.items()}


def test_yake_matches_brute_force(spark):
    text = "Google is acquiring Kaggle. Sources tell us that Google is acquiring Kaggle, a platform that hosts data science. The CEO of Kaggle declined. Data science and NASA data."
    df = spark.createDataFrame([(1, text), (2, ""), (3, "Solo word")], "id long, t string")
    rows = keywords.yake(df, "id", "t", top=1000, threshold=1e9).collect()
    want = brute_yake(text, 3, set(V.STOP_WORDS))
    assert {r.keyword: pytest.approx(r.score) for r in rows if r.id == 1} == want
    for r in rows:
        source = text if r.id == 1 else "Solo word"
        assert source[r.begin : r.end].lower().split() == r.keyword.split()
    best = sorted(want.items(), key=lambda x: (x[1], x[0]))[:5]
    top = keywords.yake(df.filter("id = 1"), "id", "t", top=5, threshold=1e9).orderBy("rank").collect()
    assert [r.keyword for r in top] == [k for k, _ in best]


def test_keywords_per_column(spark):
    df = spark.createDataFrame([(1, "good coffee machine", None), (2, None, None)], "id long, a string, b string")
    out = {r.id: r for r in keywords.keywords_per_column(df, "id", {"a": "ka", "b": "kb"}).collect()}
    assert "coffee machine" in out[1].ka and out[1].kb == [] and out[2].ka == []


# ---------------------------------------------------------------- topics, classifiers, anomalies


def themed(spark):
    a, b = "apple pear fruit orchard juice".split(), "engine wheel car road driver".split()
    rows = [(i, [(a if i % 2 else b)[(i * 7 + j * j) % 5] for j in range(12 if i % 2 else 9)], f"text {i}") for i in range(80)]
    return spark.createDataFrame(rows, "id long, tokens array<string>, text string")


def test_topic_models(spark):
    df = themed(spark)
    v = topics.term_vectors(df, "tokens")
    model = topics.lda(v, k=2, iterations=8, weight="n")
    words = {r.topic: set(r.topicWords) for r in topics.topic_words(model, 5).collect()}
    assert set(map(frozenset, words.values())) == {frozenset("apple pear fruit orchard juice".split()), frozenset("engine wheel car road driver".split())}
    assert topics.topic_cloud(model, 5).count() == 10
    rows = topics.assign_topic(model, v, "n").select("id", "topicNo").collect()
    assert len({r.topicNo for r in rows if r.id % 2}) == 1 and len({r.topicNo for r in rows}) == 2
    assert topics.topic_scores(model, v, "text").first().wordCount == 2
    for best, docs_ in (topics.lsi(df, "id", "tokens", 2), topics.nmf(df, "id", "tokens", k=2)):
        assert best.count() >= 10 and docs_.count() == 80
        by_parity = docs_.groupBy((F.col("id") % 2).alias("p")).agg(F.count_distinct("topic").alias("n")).collect()
        assert [r.n for r in by_parity] == [1, 1]


def test_frequent_terms_give_the_same_factors(spark, monkeypatch):
    df = themed(spark)
    rows = lambda pair: [sorted((r["topic"], r["term"], round(r["score"], 6)) for r in pair[0].collect()), sorted((r["id"], r["topic"], round(r["probability"], 6)) for r in pair[1].collect())]
    plain = [rows(topics.lsi(df, "id", "tokens", 2, iterations=2)), rows(topics.nmf(df, "id", "tokens", k=2, iterations=2))]
    monkeypatch.setattr(topics, "FREQUENT", 5)
    assert [rows(topics.lsi(df, "id", "tokens", 2, iterations=2)), rows(topics.nmf(df, "id", "tokens", k=2, iterations=2))] == plain


def test_embedding_topics(spark):
    rows = [(i, [float(i % 2) * 10 + (i % 7) * 0.1, float(i % 3) * 0.1, 1.0, i * 0.001, 0.5]) for i in range(40)] + [(99, [500.0, 500.0, 500.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    out = topics.embedding_topics(df, "id", "e", k=3, dims=2)
    got = {r.id: r.topic for r in out.collect()}
    assert got[99] == -1 and len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]
    tokens = df.select("id", F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("tokens"))
    info = topics.topic_info(out.join(tokens, "id"), "topic", "tokens").collect()
    assert sorted((r.keywords[0], r.doc_count, r.outliers) for r in info) == [("even", 20, 1), ("odd", 20, 1)]


def test_classifiers(spark):
    df = themed(spark).withColumn("label", (F.col("id") % 2).cast("double"))
    model = classify.train_naive_bayes(df, "tokens", "label")
    out = classify.predict_naive_bayes(model, df, "id", "tokens", ["b", "a"]).collect()
    assert all(r.label == ("a" if r.id % 2 else "b") and sum(r.probabilities) == pytest.approx(1) for r in out)
    model, scores = classify.train_text_classifier(df.filter("id < 40"), df.filter("id >= 40"), "tokens", "label", size=8, epochs=2, min_count=1)
    assert scores["validation_accuracy"] > 0.9


def test_word_vectors_are_learned_in_several_tasks(spark, monkeypatch):
    df = themed(spark).withColumn("label", (F.col("id") % 2).cast("double"))
    n = df.agg(F.sum(F.size("tokens"))).first()[0]
    model, _ = classify.train_text_classifier(df, df, "tokens", "label", size=4, epochs=1, min_count=1)
    assert model.stages[0].getOrDefault("numPartitions") == 1
    monkeypatch.setattr(classify, "TASK_WORDS", -(-n // 3))
    model, scores = classify.train_text_classifier(df, df, "tokens", "label", size=8, epochs=2, min_count=1)
    assert model.stages[0].getOrDefault("numPartitions") == 3 and scores["train_accuracy"] > 0.5
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_failing_rows_do_not_stop_a_batch(spark):
    def make():
        def score(texts):
            if (texts == "boom").any():
                raise ValueError("bad text")
            return pd.DataFrame({"POSITIVE": texts.str.len() / 10, "OTHER": 0.5})

        return score

    df = spark.createDataFrame([(1, "aaaaaaaa"), (2, "boom"), (3, "a")], "id long, t string").coalesce(1)
    out = {r.id: (r.label, r.probabilities) for r in classify.score_with_model(df, "id", "t", make, ["OTHER", "POSITIVE"]).collect()}
    assert out == {1: ("POSITIVE", [0.5, 0.8]), 2: ("error", [0.0, 0.0]), 3: ("OTHER", [0.5, 0.1])}


def test_anomalies(spark):
    df = spark.createDataFrame([(i, 10.0 if i == 10 else 0.0) for i in range(11)], "i long, v double")
    rows = anomaly.anomaly_table(df.withColumn("s", F.col("v")), [F.col("i")], "v", "s").orderBy("position").collect()
    assert rows[0].threshold == pytest.approx(9.5332, abs=1e-3) and [r.position for r in rows if r.anomaly] == [10]
    wave = spark.range(3000).select("id", F.when(F.col("id") == 1234, 500.0).otherwise(F.sin(F.col("id") / 20) * 10).alias("v"))
    scored = anomaly.rcf_scores(wave.repartition(4), "id", "v", trees=20, samples=128)
    best = scored.orderBy(F.desc("score")).first()
    assert best.id == 1234 and scored.count() == 3000
    again = anomaly.rcf_scores(wave.repartition(2), "id", "v", trees=20, samples=128)
    assert again.join(scored.select("id", F.col("score").alias("s2")), "id").filter(F.abs(F.col("score") - F.col("s2")) > 1e-9).count() == 0
    flagged = anomaly.flag_sigma(scored, "score").filter("anomaly").collect()
    assert 1234 in {r.id for r in flagged}


# ---------------------------------------------------------------- texts are read once


def test_content_tokens_extract_words_only(spark):
    texts = ["It's 3.14 and ΑΣ İstanbul x42 42 Ⅳ ⓐⓐ été _a_ -- the GOOD one", "", None, "!? ."]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dropped = [*V.STOP_WORDS, "good"]
    plain = F.filter(
        F.transform(T.tokens(F.col("t")), lambda t: F.lower(t)),
        lambda t: ~t.isin(*dropped) & t.rlike(T.WORD) & ~t.rlike(r"^[0-9][0-9.,]*$") & (F.length(t) > 1),
    )
    found = df.select(T.content_tokens(F.col("t"), ["Good"]).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in found.collect())
    alone = df.select(T.content_tokens(F.col("t"), ["Good"]))
    assert r"[^\s" not in alone._jdf.queryExecution().analyzed().toString()


def test_bags_are_counted_once(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    calls, plain = [], corpus.bag_of_words
    monkeypatch.setattr(corpus, "bag_of_words", lambda *a: calls.append(a) or plain(*a))
    rows = [(i, "apple pear apple" + (" plum" if i == 0 else ""), "en", "web") for i in range(3)] + [(3, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["tx21_build_dictionary"](spark, str(tmp_path)).collect()
    assert len(calls) == 1 and sorted(map(tuple, found)) == sorted((i, t, n) for i in range(3) for t, n in ((0, 2), (1, 1)))


def test_limited_count_vectors_read_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def split(text):
        seen.add(1)
        return text.split()

    df = spark.createDataFrame([(i, "a a b") for i in range(4)], "id long, t string")
    df = df.select("id", F.udf(split, "array<string>")("t").alias("tokens"))
    rows = corpus.count_vectors(df, "id", "tokens", vocab_size=1, min_tf=2).collect()
    assert seen.value == 4 and sorted(map(tuple, rows)) == [(i, "a", 2) for i in range(4)]


def test_yake_words_do_not_become_rows(spark, monkeypatch):
    """Words stay in the row; slices of few words, equal keys and null keys give the rows of whole documents."""
    texts = ["Google buys Kaggle. Kaggle hosts data, data science!\n\n NASA data.", " ... ! ", "", None, "Éclair ΑΣ 𝒳yz word. Zwei Wörter x42 42nd", "one word"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    whole = keywords.yake(df, "id", "t", top=1000, threshold=1e9)
    assert "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()
    want = {tuple(r) for r in whole.collect()}
    for i in (0, 4):
        mine = {r[1]: pytest.approx(r[2]) for r in want if r[0] == i}
        assert mine == brute_yake(texts[i], 3, set(V.STOP_WORDS))
    monkeypatch.setattr(keywords, "SLICE_WORDS", 2)
    assert {tuple(r) for r in keywords.yake(df, "id", "t", top=1000, threshold=1e9).collect()} == want
    best = [r for r in sorted(want, key=lambda r: (r[0], r[-1])) if r[-1] <= 3]
    assert {tuple(r) for r in keywords.yake(df, "id", "t", top=3, threshold=1e9).collect()} == set(best)
    twice = spark.createDataFrame([(None, texts[0]), (None, texts[0])], "id long, t string")
    again = {r.keyword: r for r in keywords.yake(twice, "id", "t", top=1000, threshold=1e9).collect()}
    assert again and all(r.id is None for r in again.values())
    assert (again["nasa"].begin, again["nasa"].end, again["nasa"].sentence) == (texts[0].index("NASA"), texts[0].index("NASA") + 4, 2)
