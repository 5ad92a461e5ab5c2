import json

import pytest

from pyspark.sql import functions as F

from textspark.functions.registry import register_functions
from textspark.streaming import jobs, numbering


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(folder)


def lexicon(spark):
    return spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")


def test_redact_and_offsets(spark, tmp_path):
    src = put(tmp_path / "in", a="Write to ann@mail.example.com today", b="nothing here", empty="")
    jobs.stream_redact(spark, src, str(tmp_path / "o1"), str(tmp_path / "c1"), ["EMAIL_ADDRESS"], once=True).awaitTermination()
    rows = {r.file.split("/")[-1]: r for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert rows["a.txt"].redacted == "Write to [EMAIL_ADDRESS] today"
    assert rows["b.txt"].redacted == "nothing here" and "empty.txt" not in rows
    jobs.stream_offsets(spark, src, str(tmp_path / "o2"), str(tmp_path / "c2"), ["EMAIL_ADDRESS"], once=True).awaitTermination()
    found = spark.read.json(str(tmp_path / "o2")).filter("entity_count = 1").first()
    assert (found.entities[0].start, found.entities[0].end) == (9, 29)
    # a second run sees only the new file
    put(tmp_path / "in", c="mail bob@x.org")
    jobs.stream_redact(spark, src, str(tmp_path / "o1"), str(tmp_path / "c1"), ["EMAIL_ADDRESS"], once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 3


def test_sentiment(spark, tmp_path):
    src = put(tmp_path / "in", a="a good day", b="a bad day")
    jobs.stream_sentiment(spark, src, str(tmp_path / "o"), str(tmp_path / "c"), lexicon(spark), once=True).awaitTermination()
    out = {r.file.split("/")[-1]: r.label for r in spark.read.json(str(tmp_path / "o")).collect()}
    assert out == {"a.txt": "positive", "b.txt": "negative"}


def test_bundles_are_read_as_their_files(spark, tmp_path):
    texts = {"a": "Write to ann@mail.example.com today\n", "b": "a good day\r\n\u2028x", "empty": ""}
    put(tmp_path / "in", one="\n".join(json.dumps({"file": f, "text": t}) for f, t in texts.items()), two=json.dumps({"file": "c", "text": "bob@x.org"}))
    args = (spark, str(tmp_path / "in"))
    jobs.stream_redact(*args, str(tmp_path / "o1"), str(tmp_path / "c1"), ["EMAIL_ADDRESS"], once=True, bundles=True).awaitTermination()
    found = {r.file: r.redacted for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert found == {"a": "Write to [EMAIL_ADDRESS] today\n", "b": texts["b"], "c": "[EMAIL_ADDRESS]"}
    jobs.stream_sentiment(*args, str(tmp_path / "o2"), str(tmp_path / "c2"), lexicon(spark), once=True, bundles=True).awaitTermination()
    assert {r.file: r.label for r in spark.read.json(str(tmp_path / "o2")).collect()} == {"a": "neutral", "b": "positive", "c": "neutral"}


def test_arriving_documents_come_in_few_files(spark, tmp_path):
    from checks.streaming_checks import arrived, of_file

    df = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(7, "more"), (8, ""), (9, None)], "id long, text string")
    folder = arrived(df.coalesce(1), str(tmp_path))
    assert len(list((tmp_path / "in").rglob("part-*"))) < 100
    jobs.stream_offsets(spark, folder, str(tmp_path / "o"), str(tmp_path / "c"), ["EMAIL_ADDRESS"], once=True, bundles=True).awaitTermination()
    rows = {r.id: r.text_preview for r in spark.read.json(str(tmp_path / "o")).select(of_file().alias("id"), "text_preview").collect()}
    assert len(rows) == 300 and rows[12].startswith("text 12\n") and "more" in rows[7] and "text 7" in rows[7]


def test_records(spark, tmp_path):
    batch = {"data": [{"patient_id": "P1", "text": "good, mail a@b.org"}, {"patient_id": "P2", "text": ""}, {"text": "x"}]}
    src = put(tmp_path / "in", a=json.dumps(batch), b=json.dumps({"body": json.dumps(batch)}), c="not json")
    out = str(tmp_path / "o")
    jobs.stream_records(spark, src, out, str(tmp_path / "c"), lexicon(spark), ["EMAIL_ADDRESS"], once=True).awaitTermination()
    good = spark.read.json(f"{out}/results").collect()
    assert len(good) == 2 and {g.redacted_text for g in good} == {"good, mail [EMAIL_ADDRESS]"} and {g.label for g in good} == {"positive"}
    errors = [r.error for r in spark.read.json(f"{out}/errors").collect()]
    assert sorted(errors) == ["empty text"] * 2 + ["no records"] + ["record without id"] * 2


def test_corpus_job(spark, tmp_path):
    src = put(tmp_path / "in", a="one a@b.org\n\n two \n")
    status = jobs.run_corpus_job(spark, src, str(tmp_path / "o"), str(tmp_path / "c"), "job-1", ["EMAIL_ADDRESS"])
    assert status == "COMPLETED"
    assert sorted(r.redacted for r in spark.read.parquet(str(tmp_path / "o/texts")).collect()) == ["one [EMAIL_ADDRESS]", "two"]
    assert spark.read.json(str(tmp_path / "o/jobs")).first().job_id == "job-1"


def test_pseudonyms_survive_batches_and_replays(spark, tmp_path):
    path = str(tmp_path / "reg")
    one = spark.createDataFrame([(1, "a@x.org then b@x.org"), (2, "a@x.org")], "file long, text string")
    two = spark.createDataFrame([(3, "c@x.org and a@x.org")], "file long, text string")

    def run(df, batch):
        return {r.file: r.deidentified for r in jobs.pseudonymise_batch(df, batch, "file", "text", path, ["EMAIL_ADDRESS"]).collect()}

    first = run(one, 0)
    assert first == {1: "[EMAIL_ADDRESS_2] then [EMAIL_ADDRESS_1]", 2: "[EMAIL_ADDRESS_2]"}
    second = run(two, 1)
    assert second == {3: "[EMAIL_ADDRESS_3] and [EMAIL_ADDRESS_2]"}
    assert run(two, 1) == second  # a replayed batch changes nothing
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist"):  # a lost registry does not start anew
        jobs.pseudonymise_batch(two, 2, "file", "text", str(tmp_path / "lost"), ["EMAIL_ADDRESS"])


def test_consistent_stream(spark, tmp_path):
    src = put(tmp_path / "in", a="a@x.org")
    args = (spark, src, str(tmp_path / "o"), str(tmp_path / "c"), str(tmp_path / "reg"), ["EMAIL_ADDRESS"])
    jobs.stream_consistent(*args, once=True).awaitTermination()
    put(tmp_path / "in", b="b@x.org a@x.org")
    jobs.stream_consistent(*args, once=True).awaitTermination()
    out = {r.file.split("/")[-1]: r.deidentified for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert out == {"a.txt": "[EMAIL_ADDRESS_1]", "b.txt": "[EMAIL_ADDRESS_2] [EMAIL_ADDRESS_1]"}


def numbered(spark, path):
    return {(r.label, r.text): r.number for r in numbering.read_registry(spark, path).collect()}


def by_file(spark, path):
    return {r.file.split("/")[-1]: r.deidentified for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("buckets", [1, 3])
def test_a_new_checkpoint_gives_no_number_twice(spark, tmp_path, buckets):
    src, reg = put(tmp_path / "in", a="a@x.org b@x.org", b="c@x.org a@x.org 123-45-6789"), str(tmp_path / "reg")
    jobs.stream_consistent(spark, src, str(tmp_path / "o1"), str(tmp_path / "c1"), reg, once=True, buckets=buckets).awaitTermination()
    old = numbered(spark, reg)
    assert len(old) == 4 and len({n for (label, _), n in old.items() if label == "EMAIL_ADDRESS"}) == 3
    put(tmp_path / "in2", d="d@x.org then c@x.org and 999-88-7777", e="e@x.org f@x.org g@x.org a@x.org")
    # another query, even with other buckets, goes on where the registry ends
    jobs.stream_consistent(spark, str(tmp_path / "in2"), str(tmp_path / "o2"), str(tmp_path / "c2"), reg, once=True, buckets=4 - buckets).awaitTermination()
    new = numbered(spark, reg)
    assert old.items() <= new.items() and len(new) == 9
    for label in ("EMAIL_ADDRESS", "US_SSN"):
        numbers = [n for (of, _), n in new.items() if of == label]
        assert len(set(numbers)) == len(numbers)
    assert by_file(spark, str(tmp_path / "o2"))["d.txt"] == f"[EMAIL_ADDRESS_{new['EMAIL_ADDRESS', 'd@x.org']}] then [EMAIL_ADDRESS_{old['EMAIL_ADDRESS', 'c@x.org']}] and [US_SSN_{new['US_SSN', '999-88-7777']}]"
    # the first query does not know the numbers of the second, but writes to folders of its own
    assert len(by_file(spark, str(tmp_path / "o1"))) == 2 and spark.read.option("recursiveFileLookup", True).parquet(reg).count() == 9


def test_a_replayed_batch_gives_the_same_numbers(spark, tmp_path):
    src, args = put(tmp_path / "in", a="b@x.org a@x.org", b="plain"), (str(tmp_path / "o"), str(tmp_path / "c"), str(tmp_path / "reg"))
    for _ in range(2):  # the second time without the record that the batch is done
        jobs.stream_consistent(spark, src, *args, once=True).awaitTermination()
        first = first if _ else (by_file(spark, args[0]), numbered(spark, args[2]))
        for name in ("0", ".0.crc"):
            (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    assert (by_file(spark, args[0]), numbered(spark, args[2])) == first
    assert first == ({"a.txt": "[EMAIL_ADDRESS_2] [EMAIL_ADDRESS_1]", "b.txt": "plain"}, {("EMAIL_ADDRESS", "a@x.org"): 1, ("EMAIL_ADDRESS", "b@x.org"): 2})
    put(tmp_path / "in", c="c@x.org a@x.org")
    jobs.stream_consistent(spark, src, *args, once=True).awaitTermination()
    assert by_file(spark, args[0])["c.txt"] == "[EMAIL_ADDRESS_3] [EMAIL_ADDRESS_1]"


def test_a_foreign_registry_is_an_error_for_batches(spark, tmp_path):
    path = str(tmp_path / "reg")
    one = spark.createDataFrame([(1, "a@x.org")], "file long, text string")
    two = spark.createDataFrame([(2, "b@x.org")], "file long, text string")
    for n, batch in enumerate((one, two)):
        jobs.pseudonymise_batch(batch, n, "file", "text", path, ["EMAIL_ADDRESS"]).collect()
    with pytest.raises(ValueError, match="another query"):
        jobs.pseudonymise_batch(one, 0, "file", "text", path, ["EMAIL_ADDRESS"])


def test_sql_functions(spark):
    names = register_functions(spark)
    row = spark.sql(
        "SELECT ts_squeeze('  a \\n b ') a, ts_clean_text('See http://x.y A@b.c, NOW!') b, ts_word_count(' two words ') c, ts_regex_redact('on 2024-11-01') d, "
        "ts_mask_first('1990-05-01', 'X', 4) e, ts_mask_last('abc', '*', 5) f, ts_polarity_label(0.05D) g, ts_star_bucket('3 stars') h"
    ).first()
    assert tuple(row) == ("a b", "see now", 2, "on [DATE]", "XXXX-05-01", "***", "positive", "neutral")
    assert len(names) == 11
    assert spark.range(3).select(F.call_function("ts_mask_all", F.lit("Anna"), F.lit("#")).alias("m")).first().m == "####"
