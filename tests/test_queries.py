"""Registered queries and what they are made of, on rows of their own."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from textspark.operators import deid, tagger, topics


def test_parquet_folder(spark, tmp_path):
    """The documents may be one file or a folder of files."""
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", i) for i in range(10)], "doc_id long, source string, n_chars long")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/many/labels.parquet")
    found = entry.queries()["io1_read_parquet_dir"](spark, f"{tmp_path}/many").collect()
    assert {tuple(r) for r in found} == {("a", 6, 27), ("b", 4, 18)}


def test_zip_positions(spark, tmp_path):
    vectors = [(1, [i / 64 for i in range(64)]), (2, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = entry.queries()["jn2_zip_positions"](spark, str(tmp_path)).collect()
    want = {(1, f"t{i}", round(i / 64, 9)) for i in range(64)} | {(2, f"t{i}", None) for i in range(64)}
    assert len(found) == 128 and {tuple(r) for r in found} == want
    short = spark.createDataFrame([(0, ["a", "b"], [1.5])], "topic int, terms array<string>, weights array<double>")
    assert [tuple(r) for r in topics.zip_terms(short, "topic", "terms", "weights").collect()] == [(0, "a", 1.5), (0, "b", None)]


def test_entities_are_found_once_a_row(spark):
    """A Python function cannot be called for each keyword inside a lambda, only once for each row."""
    found = F.udf(lambda t: [t, "New York City"], "array<string>")
    rows = spark.createDataFrame([("John Smith", ["john", "saw", "York", "john"]), (None, ["x"])], "text string, keywords array<string>")
    kept = rows.select(deid.keep_overlapping(F.col("keywords"), found("text")).alias("k")).collect()
    assert [r.k for r in kept] == [["john", "York"], []]


def test_factors_need_no_lookup_of_frequent_terms(spark, monkeypatch):
    """Vectors go to blocks of documents: however frequent a term is, its rows are not joined."""

    def refused(*_args, **_kwargs):
        raise AssertionError("rows of frequent terms are looked up")

    monkeypatch.setattr(topics, "FREQUENT", 1)
    monkeypatch.setattr(topics, "counted_lookup", refused)
    rows = [(i, ["all", "a" if i % 2 else "b"]) for i in range(8)] + [(8, []), (9, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    best, docs = topics.lsi(df, "id", "tokens", 2, iterations=2)
    assert best.count() == 6 and docs.count() == 10
    best, docs = topics.nmf(df, "id", "tokens", k=2, iterations=2)
    assert best.count() == 6 and {r["id"] for r in docs.collect()} == set(range(8))


def test_tags_are_found_by_one_lookup_of_numbers(spark, monkeypatch):
    """A token carries the number of its vector, found once for each word, not a vector for each of its endings."""
    seen, plain = [], tagger.looked_up

    def counted(df, tokens, table, term, value, out):
        seen.append(table.schema[value].dataType.typeName())
        return plain(df, tokens, table, term, value, out)

    monkeypatch.setattr(tagger, "looked_up", counted)
    known = spark.createDataFrame([(["Runs", "the", "talking"], ["V", "D", "G"])] * 3, "t array<string>, tags array<string>")
    model = tagger.train_tagger(known, "t", "tags")
    rows = spark.createDataFrame([(1, ["the", "walking", None, "RUNS"]), (2, None), (3, [])], "id int, t array<string>")
    got = {r["id"]: r["tags"] for r in tagger.tag_rows(rows, "t", model).collect()}
    assert got[1][:2] == ["D", "G"] and got[1][3] == "V" and got[2] is None and got[3] == []
    assert seen == ["long"]
