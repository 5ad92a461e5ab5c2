import os
import random

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
WORDS = ["river", "stone", "window", "paper", "garden", "lamp", "music", "street", "winter", "table", "cloud", "bread", "glass", "horse", "letter", "north", "silver", "corner", "yellow", "market"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", "er"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): prose, and what no operator may stumble over."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 30 + i), "en") for i in range(30)]
    rows += [(30, None, "en"), (31, "", "en"), (32, " \n\t ", None), (None, prose(rng, 40), "en"), (33, rows[3][1], "en"), (34, rows[3][1].upper(), "de")]
    rows += [(35, "word", None), (36, "é😀 \x00 日本", "xx"), (37, prose(rng, 30_000), "en"), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same with further columns, whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, fingerprint string, score double, part int, kept string, key string, url string, n int, tie long, `value` string, label string, `odd name` string"
    rows = [(*r, "f", 0.5, 1, "k", "y", "u", 2, 3, "v", "l", "o") for r in odd_rows]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
