import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from textspark.llm import quality_rules, registry, url_filter, warc

# ---------------------------------------------------------------- urls


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://A.NET/", "http://a.net", "https://x.example.net/en/1?a=b", "https://example.net/de/", "http://badexample.net/en/x", "http://w.example.com/de/#t", "ftp://é.ORG/fr/",
    "http://a.org/fr", "://net/x", "http://h?q=://net/", "http://h\n/p\nq", "http://" + "a" * 5000 + ".net/" + "b/" * 3000,
]


def test_rules_of_urls(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, URLS[5])], "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS label", "2 AS slot_1")
    rows = url_filter.judged(pages).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        host, path, rule, verdict = plain_rule(URLS[r["page_id"] if r["page_id"] is not None else 5])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judged(pages.limit(0)).collect() == []


def test_shape_of_a_url(spark):
    url = "http://a-b.c.net/x/y1?p=1&q=22#top"
    host, path = url_filter.host_and_path(url_filter.F.col("url"))
    r = url_filter.with_shape(spark.createDataFrame([(url,)], "url string").withColumn("host", host).withColumn("path", path)).first()
    freq = Counter(url)
    assert r["entropy"] == pytest.approx(-sum(n / len(url) * math.log(n / len(url)) for n in freq.values()))
    assert [r[c] for c in ("length", "depth", "parameters", "query_length", "labels", "hyphens", "fragment")] == [len(url), 2, 2, 8, 2, 1, 1]
    assert r["digits"] == pytest.approx(4 / len(url))


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(1)

    def url(bad):
        return f"http://{rng.choice(WORDS)}.test/" + ("/".join(str(rng.randrange(10**6)) for _ in range(4)) if bad else rng.choice(WORDS))

    WORDS = ["alpha", "beta", "gamma", "delta"]
    labelled = [(url(i % 2), i % 2) for i in range(400)]
    fresh = [(i, url(i % 2)) for i in range(200)]
    known = spark.createDataFrame(labelled + labelled[:50] * 4, "url string, label int")
    rows = url_filter.judged(spark.createDataFrame(fresh, "page_id long, url string"), known).collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in rows) >= 190


@pytest.mark.parametrize("fits", [True, False])
def test_each_suffix_has_its_own_rate(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(url_filter.scale, "fits", lambda *_: False)
    n = 6000  # more domains than any table of slots
    host, path = url_filter.host_and_path(url_filter.F.col("url"))
    urls = spark.range(2 * n).selectExpr("concat('http://w.d', id % 6000, '.test/') AS url", "cast(id % 6000 % 2 AS int) AS label")
    shaped = url_filter.with_shape(urls.withColumn("host", host).withColumn("path", path))
    rates, mean = url_filter.suffix_statistics(shaped)
    more = spark.createDataFrame([("http://other.new/", None)], "url string, label int").withColumn("host", host).withColumn("path", path)
    rows = url_filter.with_suffixes(shaped.unionByName(url_filter.with_shape(more)), rates, mean).select("label", "long_suffix", "short_suffix").collect()
    assert mean == 0.5 and len(rows) == 2 * n + 1
    p = url_filter.PRIOR
    expected = {0: p * 0.5 / (2 + p), 1: (2 + p * 0.5) / (2 + p), None: 0.5}
    assert all(r["long_suffix"] == pytest.approx(expected[r["label"]]) and r["short_suffix"] == pytest.approx(0.5) for r in rows)


# ---------------------------------------------------------------- archives


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        tree, out = warc.LoserTree([iter([((x,),) for x in r]) for r in runs]), []
        while tree.peek() is not None:
            out.append(tree.pop()[0][0])
        assert out == sorted(x for r in runs for x in r)


BIG = "x" * 120
PAGES = [
    (1, "http://a.b/1", "<p>\r\n\r\nWARC/1.1\r\nhi " + BIG), (2, "HTTP://A.b/1", BIG + "\r\n"), (3, "http://a.b/1", BIG + "\r\n"), (4, None, None), (5, "no\nurl", ""), (None, "u", BIG + "\r\n"),
    (2, "HTTP://A.b/1", BIG + "\r\n"), (7, "http://é.com/ü?q#f", "é\u2028\n\nñ" + BIG * 3000), (8, "x://q", "\r\n\r\n"), (9, "x://q", "short"), (10, "x://q", "short"), (11, "x://r", BIG),
]


def test_archives_and_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'a' AS payload", "1 AS part", "'k' AS url_key", "'t' AS record_type").repartition(3)
    path = str(tmp_path / "archives")
    rows = warc.archived(pages, path=path).collect()
    expected = []
    for i, url, html in PAGES:
        body = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "").encode() == body and j is not None), default=None)
        again = len(body) >= 100 and first is not None and i != first
        expected.append((i, url, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == sorted(expected, key=str)
    bodies = {(r["page_id"], r["url"]): bytes(r["payload"]).decode() for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert all(bodies[i, url] == (html or "") for i, url, html in PAGES if (i, url) in bodies)
    assert warc.archived(pages.limit(0)).collect() == []


def test_index_is_in_one_order(spark, monkeypatch):
    for name, value in (("RANGE", 40), ("BLOCK", 7), ("ADMIT", 3)):
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(4)
    pages = spark.createDataFrame([(i, "http://hot.net/" if i % 3 == 0 else f"http://{rng.choice('abc')}.org/{rng.randrange(9)}", prose(rng, 5)) for i in range(300)], "page_id long, url string, html string")
    rows = warc.archived(pages.repartition(5), captured=warc.F.timestamp_seconds(warc.F.col("page_id") % 50)).orderBy("part", "place").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 300
    assert sum(r["place"] == 0 for r in rows) == len({r["part"] for r in rows}) > 4
    assert len({r["part"] for r in rows if r["url_key"] == "net,hot)/"}) > 1  # a hot key is in several ranges


def test_more_overlapping_runs_than_are_admitted_at_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "ADMIT", 3)
    captures = spark.range(400).selectExpr("'k' AS url_key", "timestamp_seconds(id % 7) AS captured", "id AS page_id").repartition(20, "page_id")
    rows = warc.merged_index(captures).orderBy("part", "place").collect()
    keys = [(r["captured"], r["page_id"]) for r in rows]
    assert keys == sorted(keys) and sorted(i for _, i in keys) == list(range(400))
    assert [r["place"] for r in rows] == list(range(400))


def test_damaged_records_are_errors(spark, tmp_path):
    path = str(tmp_path / "archives")
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 1\r\nContent-Length: "
    spark.createDataFrame([(f"{head}{len(warc.HTTP) + 1}\r\n\r\n{warc.HTTP}x",)], "value string").write.option("lineSep", warc.END).text(path)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archives(spark, path).collect()


# ---------------------------------------------------------------- pipeline and registration


def test_all_are_registered():
    queries, sql = registry.load()
    assert sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op")) == list(range(1, 14))
    assert queries["pipeline"] is corpus_pipeline.run and set(sql) <= set(queries)


@pytest.fixture(scope="module")
def corpus(spark, odd_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    item = " ".join("".join(rng.choice("bcdfgklm") + rng.choice("aeiou") for _ in range(3)) for _ in range(25))
    rows = [(5000, prose(rng, 40) + " " + item + " " + prose(rng, 40), "en"), (5001, prose(rng, 60) + " a.b@c.org", "en")]
    odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_its_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "pack"]
    kept = {str(r["doc_id"]) for r in quality_rules.judged(docs).where("kept").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        assert docs.columns == spark.read.parquet(f"{corpus}/documents.parquet").columns
    rest = docs.collect()
    ids = {str(r["doc_id"]) for r in rest}
    assert ids == kept - {"5000", "33", "34"} and len(rest) == len(ids)  # a leak, and two copies of row 3
    assert not any("a.b@c.org" in r["text"] for r in rest)
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert {str(r["doc_id"]) for r in pieces} == ids
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{corpus}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


