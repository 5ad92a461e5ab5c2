from textspark.streaming import numbering


def test_texts_are_carried_by_many_groups(spark):
    rows = [(f"f{i}", "x", []) for i in range(50)]
    df = spark.createDataFrame(rows, "file string, text string, spans array<struct<start: int, end: int, text: string, label: string>>")
    assert numbering.value_rows(df, "file", "text", "spans", 1).select("bucket").distinct().count() > 10
