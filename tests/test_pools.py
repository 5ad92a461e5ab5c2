"""Pools as tables: the picks of in-plan lists, at any size."""

import pytest
from pyspark.sql import functions as F

from textspark.functions import spans as S
from textspark.operators import deid, pii, pools


def test_tables_and_lists_pick_alike(spark, tmp_path):
    (tmp_path / "names.txt").write_text("Zoe Ash#PERSON\nBen Oak#PERSON\nno label\nAda Elm#PERSON\nBen Oak#PERSON\nRoma#LOCATION\n")
    table = pools.read_pool(spark, str(tmp_path))
    docs = spark.createDataFrame([(i, f"Anna{i % 5} met Bob{i % 3} in Town{i % 2}" if i % 4 else "nobody", "k") for i in range(40)] + [(99, None, "k")], "id long, t string, value string")
    found = docs.withColumn("spans", S.non_overlapping(S.first_wins(S.match_many(F.col("t"), [("PERSON", r"(?:Anna|Bob)\d"), ("LOCATION", r"Town\d"), ("VERB", "met")]))))
    lists = {"PERSON": ["Ada Elm", "Ben Oak", "Zoe Ash"], "LOCATION": ["Roma"]}
    want = {r["id"]: r["o"] for r in deid.obfuscate(found, "t", "spans", "file", lists, 7, "o").collect()}
    out = pools.obfuscate_from(found, "id", "t", "spans", table, 7, "o")
    assert {r["id"]: r["o"] for r in out.collect()} == want and out.columns == [*found.columns, "o"]
    assert want[1].endswith("in Roma") and "[VERB]" in want[1] and want[0] == "nobody" and want[99] is None


def test_numbers_and_sizes(spark):
    table = spark.createDataFrame([("A", "y"), ("A", "x"), ("A", "x"), ("B", None), (None, "z"), ("C", "é")], "label string, value string")
    numbered, sizes = pools.pool_table(table)
    assert sorted(tuple(r) for r in numbered.collect()) == [("A", 0, "x"), ("A", 1, "y"), ("C", 0, "é")]
    assert sorted(tuple(r) for r in sizes.collect()) == [("A", 2), ("C", 1)]


def test_a_large_pool_is_not_in_the_plan(spark):
    table = spark.range(700_000).select(F.lit("PERSON").alias("label"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("value"))
    docs = spark.range(300).select("id", F.concat(F.lit("user"), F.col("id").cast("string"), F.lit(" wrote")).alias("t"))
    found = docs.withColumn("spans", S.match_spans(F.col("t"), r"user\d+", "PERSON"))
    out = pools.obfuscate_from(found, "id", "t", "spans", table, out="o")
    assert "name 1" not in out._jdf.queryExecution().toString()
    got = {r["id"]: r["o"] for r in out.collect()}
    assert len(set(got.values())) > 290 and all(o.startswith("name ") and o.endswith(" wrote") for o in got.values())


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", "x"), (3, None, "y")], "id long, `first name` string, value string")
    table = spark.createDataFrame([("NAME", f"n{i}") for i in range(50)] + [("CITY", "c")], "label string, value string")
    rows = sorted(pools.columns_from_pool(df, {"first name": "NAME", "value": "CITY"}, table, {"first name": 3}).collect(), key=str)
    by = [(r["id"], r["first name"], r["value"]) for r in rows]
    assert len(by) == 4 and {v for _, n, v in by if v} == {"c"} and sum(v is None for *_, v in by) == 1
    assert len({n for i, n, _ in by if i in (1, 3) and n}) == 1 and sum(n is None for _, n, _ in by) == 1
    with pytest.raises(ValueError, match="STREET"):
        pools.columns_from_pool(df, {"value": "STREET"}, table)


def test_pseudonyms_in_the_row_and_by_joins_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7}@x.org then b{i % 5}@y.org" if i % 3 else "none") for i in range(50)] + [(77, None)], "id long, t string")
    found = pii.detect(docs, "t", ["EMAIL_ADDRESS"])
    one = {r["id"]: r["deidentified"] for r in deid.consistent(found, "id", "t", "spans").collect()}
    monkeypatch.setattr(deid, "REGISTRY_SHARDS", 0)
    two = {r["id"]: r["deidentified"] for r in deid.consistent(found, "id", "t", "spans").collect()}
    assert one == two and len(one) == 51 and one[0] == "none" and one[77] is None
