import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import prose

from textspark.llm import components, quality_rules, simhash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_near_components_equal_all_pairs(spark, odd_docs, odd_rows):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_components(odd_docs).collect()]
    prints = [plain_print(t) for _, t, _ in odd_rows]
    at = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    low = {}
    for (d, _, _), c in zip(odd_rows, at, strict=True):
        low[c] = min(x for x in (d, low.get(c)) if x is not None) if d is not None or low.get(c) is not None else None
    expected = [(d, f"{f:016x}", low[c]) for (d, _, _), f, c in zip(odd_rows, prints, at, strict=True)]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_empty_table_has_no_components(no_docs):
    assert simhash.near_components(no_docs).collect() == []
    assert simhash.first_of_each(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("reach", [2, 3])
def test_trees_lose_no_pair(reach):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)), base[:1] ^ rng.integers(0, 4096, 3000, dtype=np.uint64)]))
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= reach, 1))
    whole = roots(len(points), near)
    depth = 4
    tree = simhash.fit(points[::3], depth, reach)
    who, shard = simhash.route(points, tree, depth, reach)
    links = []
    for s in np.unique(shard):
        own = who[shard == s]
        f = points[own]
        pairs = simhash.near_pairs(f, reach, lambda cell, f=f: simhash.forest(cell, f, reach))
        assert (np.bitwise_count(f[pairs[:, 0]] ^ f[pairs[:, 1]]) <= reach).all()
        links += own[pairs].tolist()
    assert roots(len(points), links) == whole
    assert len(np.unique(shard)) > 4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, None), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_first_of_each_group_stays(spark, odd_docs, odd_rows):
    rng = random.Random(9)
    base = prose(rng, 120)
    copies = []
    for i in range(25):
        words = base.split()
        words[rng.randrange(120)] = f"changed{i}"
        copies.append(" ".join(words))
    assert min(jaccard(base, c) for c in copies) >= 0.8
    far = " ".join(base.split()[:60]) + " " + prose(rng, 60)
    docs = odd_docs.unionByName(spark.createDataFrame([(1000 + i, t, "en") for i, t in enumerate([base, *copies, far])], "doc_id long, text string, lang string"), allowMissingColumns=True)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert max(ids.values()) == 1
    # 30 to 32 have no words, 33 and 34 are row 3, row 5 is there three times
    expected = {*range(31), None, 35, 36, 37, 1000, 1026}
    assert set(ids) == expected


def test_dense_cells_keep_true_neighbours():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, simhash.CHECK, dtype=np.uint64)
    check = np.stack([centre ^ (np.uint64(1) << rng.integers(0, 64, simhash.CHECK, dtype=np.uint64)) for _ in range(1500)])
    pairs, whole = simhash.candidates(np.arange(1500), np.zeros(1500, np.uint32), check, 2, 20, np.arange(1500))
    assert set(roots(1500, pairs.tolist())) == {0}
    assert not whole and len(pairs) == 1499
    far = rng.integers(0, 2**63, (3, 1, simhash.CHECK), dtype=np.uint64)
    groups = np.concatenate([check[:700], *(check[700:900] ^ x for x in far)])
    pairs, whole = simhash.candidates(np.arange(1300), np.zeros(1300, np.uint32), groups, 2, 20, np.arange(1300))
    assert not whole and len(pairs) == 1300 - 4 and len(set(roots(1300, pairs.tolist()))) == 4


def family(base, name, size):
    """Texts that differ in their last word."""
    return [f"{base} {name}{i}" for i in range(size)]


def test_groups_beside_a_larger_one_are_linked(spark):
    rng = random.Random(21)
    large, words = prose(rng, 400), prose(rng, 400).split()
    chain = []
    for step in range(6):  # neighbours differ in one run of words, others in two or more
        words[step * 60 : step * 60 + 24] = prose(rng, 24).split()
        chain.append(" ".join(words))
    assert min(jaccard(a + " x", b + " y") for a, b in zip(chain, chain[1:], strict=False)) >= 0.82
    assert max(jaccard(a, b) for i, a in enumerate(chain) for b in chain[i + 2 :]) < 0.8
    texts = family(large, "large", 150)
    for k, base in enumerate(chain):
        texts += family(base, f"chain{k}", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.first_of_each(docs).collect()} == {0, 150}


def test_crossing_pairs_are_whole_or_named_as_open():
    rng = np.random.default_rng(4)
    check = rng.integers(0, 2**63, (60, simhash.CHECK), dtype=np.uint64)
    check[20:] = check[20]  # forty equal points of four roots
    root = np.concatenate([np.zeros(20, np.int64), np.arange(40) % 4 + 1])
    pairs, more = simhash.crossing(root, check, 20, 100)
    assert len(more) == 0 and {tuple(sorted(p)) for p in pairs.tolist()} == {(i, j) for i in range(20, 60) for j in range(i + 1, 60) if root[i] != root[j]}
    pairs, more = simhash.crossing(root, check, 20, 3)
    assert set(more.tolist()) == set(range(20, 60)) and len(pairs) == 120


def test_crossing_pairs_come_from_one_table():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, simhash.LANES, dtype=np.uint64)
    value = np.stack([base ^ (rng.integers(0, 2**63, simhash.LANES, dtype=np.uint64) & rng.integers(0, 2**63, simhash.LANES, dtype=np.uint64) & rng.integers(0, 2**63, simhash.LANES, dtype=np.uint64)) for _ in range(40)])
    parts, root = value.view(np.uint32), np.arange(40)
    found = [tuple(sorted(p)) for t in range(simhash.TABLES) for p in simhash.crossing(root, value, 1024, 100, t)[0].tolist()]
    near = (np.bitwise_count(parts[:, None] ^ parts[None]) <= simhash.REACH).any(2)
    assert Counter(found).keys() == {(i, j) for i in range(40) for j in range(i + 1, 40) if near[i, j]}
    assert max(Counter(found).values()) <= 2  # once from each end


# ---------------------------------------------------------------- quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def plain_model(texts):
    """n-grams of each text, counts of each order and its discounts, one language, with dictionaries."""
    order, edge = quality_rules.ORDER, chr(quality_rules.EDGE)
    grams = [[s[i : i + order] for i in range(len(s) - order + 1)] for s in (edge * (order - 1) + t + edge for t in texts)]
    counts = {order: Counter(g for gs in grams for g in gs)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def off(k):
        n = [sum(c == j for c in counts[k].values()) for j in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        return [0] + [min(j, max(0, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 for j in (1, 2, 3)]

    return grams, counts, {k: off(k) for k in counts}


def plain_probability(g, counts, offs, own=None):
    """Modified Kneser-Ney; ``own`` has n-grams that do not count in the top order."""
    k, own = len(g), own or {}
    if not k:
        return 1 / (len(counts[1]) + 1)
    lower = plain_probability(g[1:], counts, offs)
    of = [h for h in counts[k] if h[:-1] == g[:-1]]
    total = sum(counts[k][h] - own.get(h, 0) for h in of)
    left = sum(offs[k][min(counts[k][h], 3)] for h in of)
    c = counts[k].get(g, 0) - own.get(g, 0)
    return min(1, max(0, c - offs[k][min(c, 3)]) / total + min(1, left / total) * lower) if total else lower


def plain_log_perplexities(texts):
    grams, counts, offs = plain_model(texts)
    return [-sum(np.log(plain_probability(g, counts, offs, Counter(gs))) for g in gs) / len(gs) for gs in grams]


def test_counts_and_verdicts(odd_docs, odd_rows):
    rows = quality_rules.judged(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    by_id = {d: t for d, t, _ in odd_rows}
    for r in rows:
        assert tuple(r[c] for c in quality_rules.BASE) == plain_counts(by_id[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["low"] <= r["log_perplexity"] <= r["high"])
    stage = quality_rules.kept(odd_docs)
    assert stage.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in stage.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])


def test_empty_table_has_no_verdicts(no_docs):
    assert quality_rules.judged(no_docs).collect() == []
    assert quality_rules.kept(no_docs).collect() == []


def test_perplexity_equals_plain_model(spark):
    texts = ["the cat sat on the mat.", "The dog sat on a log!", "a cat and a dog", ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.judged(docs).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(plain_log_perplexities(texts))


def test_model_sums_to_one_in_any_context(spark):
    texts = ["abcab abd abcab", "abe"]
    _, counts, offs = plain_model(texts)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    grams = quality_rules.blocked(docs.select("doc_id", "lang", "text")).where("gram is not null")
    trained, off = quality_rules.model(grams.select("lang", "gram", "n"))
    top = {r["gram"]: r for r in trained.collect()}
    assert set(top) == set(counts[quality_rules.ORDER])
    d = off.first()
    for context in {g[:-1] for g in top}:
        rows = [r for g, r in top.items() if g[:-1] == context]
        seen = sum((r["n"] - d[f"d{min(r['n'], 3)}"]) / r["total"] for r in rows)
        assert seen + rows[0]["left"] / rows[0]["total"] == pytest.approx(1)
        for g in (h for h in top if h[:-1] == context):
            assert top[g]["lower"] == pytest.approx(plain_probability(g[1:], counts, offs))
    shorter = quality_rules.ORDER - 1
    for context in {g[:-1] for g in counts[shorter]}:
        unknown = plain_probability(context + "?", counts, offs)
        assert sum(plain_probability(context + x, counts, offs) for x in counts[1]) + unknown == pytest.approx(1)


def test_strange_text_is_out_of_band(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 200), "en") for i in range(80)] + [(900, " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(100)), "en")]
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not verdicts.pop(900) and all(verdicts.values())


def test_blocks_and_pieces_score_alike(spark, odd_docs, monkeypatch):
    whole = {(str(r["doc_id"]), r["log_perplexity"]) for r in quality_rules.judged(odd_docs).collect()}
    monkeypatch.setattr(quality_rules, "BLOCK", 100)
    assert {(str(r["doc_id"]), r["log_perplexity"]) for r in quality_rules.judged(odd_docs.repartition(3)).collect()} == whole


def test_long_text_in_pieces_gives_the_same_ngrams(monkeypatch):
    text = prose(random.Random(1), 500) + " Ärger 漢字かな 😀 \x00"

    def counted():
        own = quality_rules.Counts(0)
        own.add(text.encode())
        own.merge()
        return dict(zip(own.alphabet.strings(own.code), own.n.tolist(), strict=True))

    padded = "\x03" * 3 + text + "\x03"
    whole = counted()
    assert whole == Counter(padded[i : i + 4] for i in range(len(padded) - 3))
    monkeypatch.setattr(quality_rules, "PIECE", 97)
    assert counted() == whole


def test_alphabets_without_room_begin_a_block(spark):
    every = [chr(c) for c in range(4, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(every[:60_000]), "".join(every[40_000:]), "".join(every), "plain words " * 30]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(rows)], "doc_id long, text string, lang string").coalesce(1)
    assert quality_rules.blocked(docs).where("gram is null").select("block").distinct().count() == 3
    found = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.judged(docs).collect()}
    assert len(found) == 4 and all(np.isfinite(v) for v in found.values())


def test_model_grows_with_the_texts_in_every_script(spark):
    """Letters beyond ASCII are told apart: a text of a language's letters in another order is out of its band."""
    rng = random.Random(5)
    syllables = ["при", "вет", "сло", "во", "дом", "мир", "ка", "то", "на", "ре"]
    sound = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(150)) for _ in range(60)]
    letters = "".join(syllables)
    odd = " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(150))
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate([*sound, odd])], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality_rules.judged(docs).collect() if not r["kept"]} == {60}


def test_quality_rules_shuffle_no_text(spark, odd_docs, capsys):
    """Texts go to their blocks once, in buckets, and a bounded table of rejected keys is broadcast whatever Spark thinks of its size."""
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quality_rules.kept(odd_docs).explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
        quality_rules.measured(odd_docs.select("doc_id", quality_rules.language("lang").alias("lang"), "text")).explain()
        lines = capsys.readouterr().out.splitlines()
        body = next(i for i, x in enumerate(lines) if "Bucketed: true" in x and "body#" in x)
        above = [x for x in lines[:body] if len(x) - len(x.lstrip(" :+-")) < len(lines[body]) - len(lines[body].lstrip(" :+-"))]
        assert not any("Exchange hashpartitioning" in x for x in above)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
