"""Languages by profiles of characters against a plain version."""

from collections import Counter

from textspark.operators import deid, language

TRAINING = [
    ("en", "the cat sat on the mat and the dog ran with the other dogs through the whole house"),
    ("fr", "le chat est dans la maison avec les autres chats et le chien qui dort sous la table"),
    ("de", "die Katze sitzt auf der Matte und der Hund schläft unter dem großen Tisch im Haus"),
    ("ru", "кошка сидит на ковре и собака спит под большим столом в нашем доме"),
    ("ja", "猫はマットの上に座っています。犬はテーブルの下で寝ています。"),
    (None, "xyz xyz xyz"),
]


def plain_grams(text):
    import regex

    out = Counter()
    for w in regex.findall(r"\p{L}+", text.lower()):
        w = f"_{w}_"
        out.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n] != "_")
    return [g for g, _ in sorted(out.items(), key=lambda x: (-x[1], x[0].encode()))]


def test_profiles_and_distances_equal_plain_ones(spark):
    df = spark.createDataFrame(TRAINING, "lang string, t string")
    table = language.language_profiles(df, "t", "lang", 50)
    got = {}
    for r in table.collect():
        got.setdefault(r["language"], {})[r["rank"]] = r["gram"]
    want = {name: plain_grams(t)[:50] for name, t in TRAINING if name}
    assert {n: [g[i] for i in sorted(g)] for n, g in got.items()} == want
    texts = ["the mat in the house", "la table de la maison", "der große Hund im Haus", "собака под столом", "犬はマットの上で寝ています", "12345 67890 !!!", "short", None, "", "hund chat the собака"]
    rows = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "id long, t string, gram string").repartition(3)
    found = {r["id"]: r["language"] for r in language.detect_by_profile(rows, "t", table, top=50).collect()}

    def nearest(text):
        if not text or len(text.strip(" ")) < 10 or not plain_grams(text):
            return "unknown"
        own = plain_grams(text)[:50]
        away = {n: sum(abs((p.index(g) + 1 if g in p else 50 + i) - i) for i, g in enumerate(own, 1)) for n, p in want.items()}
        return min(sorted(away), key=away.get)

    assert found == {i: nearest(t) for i, t in enumerate(texts)}
    assert [found[i] for i in range(8)] == ["en", "fr", "de", "ru", "ja", "unknown", "unknown", "unknown"]
    kept = language.keep_language(rows, ["t"], table, "fr")
    assert [r["id"] for r in kept.collect()] == [1] and kept.columns == ["id", "t", "gram"]


def test_no_profiles(spark):
    empty = language.language_profiles(spark.createDataFrame([], "lang string, t string"), "t", "lang")
    rows = spark.createDataFrame([(1, "some longer text")], "id long, t string")
    assert language.detect_by_profile(rows, "t", empty).first()["language"] == "unknown"


def test_redaction_by_profiles(spark):
    table = language.language_profiles(spark.createDataFrame(TRAINING, "lang string, t string"), "t", "lang")
    docs = spark.createDataFrame([(1, "the dog of the house is at x@y.org"), (2, "le chien de la maison est chez dog")], "id long, t string")
    phrases = spark.createDataFrame([("en", "dog", "NRP"), ("fr", "chien", "PERSON")], "language string, phrase string, label string")
    got = {r["id"]: (r["language"], r["redacted"]) for r in deid.redact_by_language(docs, "t", phrases, profiles=table).collect()}
    assert got == {1: ("en", "the [NRP] of the house is at [EMAIL_ADDRESS]"), 2: ("fr", "le [PERSON] de la maison est chez dog")}
