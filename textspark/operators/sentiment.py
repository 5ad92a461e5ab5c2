"""Lexicon sentiment over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as SC
from ..functions import text as T
from ..functions.expr import let, unnest
from ..resources import values as V
from .filters import record_problem, route
from .scale import lookup

EDGE = "[" + "".join("\\" + c for c in V.PUNCTUATION) + "]+"


def _modifiers(lexicon: DataFrame, word: str) -> tuple[list[str], list[str], list[str]]:
    """Boosters and negations that are not lexicon words themselves; the lists are short, so is the answer."""
    listed = [*V.BOOSTER_UP, *V.BOOSTER_DOWN, *V.NEGATIONS]
    known = {r[0] for r in lexicon.filter(F.col(word).isin(*listed)).select(word).distinct().collect()}
    return tuple([w for w in words if w not in known] or [""] for words in (V.BOOSTER_UP, V.BOOSTER_DOWN, V.NEGATIONS))


def scored_tokens(text: Column, up: Sequence[str], down: Sequence[str], negations: Sequence[str]) -> Column:
    """Array of (i, word, caps, weight, before[3]) per text; everything a token needs from its neighbours."""

    def bare(t):
        stripped = F.regexp_replace(t, f"^{EDGE}|{EDGE}$", "")
        return let(stripped, lambda s: F.when(F.length(s) <= 2, t).otherwise(s))

    shout = lambda w: (w == F.upper(w)) & (w != F.lower(w))

    def build(ws: Column) -> Column:
        low = F.transform(ws, lambda w: F.lower(w))
        n_caps = F.size(F.filter(ws, shout))
        facts = F.struct(
            low.alias("low"),
            ((n_caps > 0) & (n_caps < F.size(ws))).alias("mixed"),
            (F.array_position(low, F.lit("but")).cast("int") - 1).alias("but"),
        )

        # bound once per text; inside the per-token lambdas they would be computed for every token
        def with_facts(f: Column) -> Column:
            modifiers = F.transform(
                ws,
                lambda w, i: let(
                    F.get(f["low"], i),
                    lambda x: F.struct(
                        F.when(x.isin(*up), V.BOOST).when(x.isin(*down), -V.BOOST).otherwise(0.0).alias("boost"),
                        (shout(w) & f["mixed"]).alias("caps"),
                        (x.isin(*negations) | x.contains("n't")).alias("neg"),
                    ),
                ),
            )
            nothing = F.struct(F.lit(0.0).alias("boost"), F.lit(False).alias("caps"), F.lit(False).alias("neg"))
            but = f["but"]

            def with_modifiers(mod: Column) -> Column:
                def one(word, i):
                    return F.struct(
                        i.alias("i"),
                        word.alias("word"),
                        F.get(mod, i)["caps"].alias("caps"),
                        F.when((but < 0) | (i == but), 1.0).when(i < but, V.BUT_BEFORE).otherwise(V.BUT_AFTER).alias("weight"),
                        F.get(mod, i)["boost"].alias("own"),
                        *[F.when(i >= d, F.get(mod, i - d)).otherwise(nothing).alias(f"b{d}") for d in (1, 2, 3)],
                    )

                return F.transform(f["low"], one)

            return let(modifiers, with_modifiers)

        return let(facts, with_facts)

    return let(F.transform(T.words(text), bare), build)


def with_token_valence(words: DataFrame, valence: str = "valence", out: str = "value") -> DataFrame:
    """Valence of a token after capitals, boosters and negations of the three words before it.

    Each step is a column of its own: nested into one expression the running value
    would be copied into every branch again and again.
    """
    v = F.col(out)
    loud = F.when(v > 0, V.CAPS).when(v < 0, -V.CAPS).otherwise(0.0)
    staged = words.withColumn(out, F.col(valence).cast("double"))
    staged = staged.withColumn(out, v + F.when(F.col("caps"), loud).otherwise(0.0))
    for d, decay in zip((1, 2, 3), V.BOOST_DECAY):
        b = F.col(f"b{d}")
        boost = F.when(v < 0, -b["boost"]).otherwise(b["boost"])
        shout = F.when(b["caps"], F.when(v > 0, V.CAPS).otherwise(-V.CAPS)).otherwise(0.0)
        staged = staged.withColumn(out, v + F.when(b["boost"] != 0, (boost + shout) * decay).otherwise(0.0))
        staged = staged.withColumn(out, F.when(b["neg"], v * V.NEGATION).otherwise(v))
    return staged.withColumn(out, F.when((F.col("own") != 0) | v.isNull(), 0.0).otherwise(v * F.col("weight")))


def punctuation_emphasis(text: Column) -> Column:
    bangs = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(V.EXCLAIM_MAX)) * V.EXCLAIM_STEP
    asks = F.length(text) - F.length(F.replace(text, F.lit("?")))
    total = bangs + F.when(asks > 3, V.QUESTION_CAP).when(asks > 1, asks * V.QUESTION_STEP).otherwise(0.0)
    return F.when(text.isNotNull(), total)


def word_scores(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """(key, i, word, valence, emphasis) of every word of every text.

    ``lexicon`` has (word, valence). With a lexicon of checked size nothing is shuffled.
    """
    up, down, negations = _modifiers(lexicon, "word")
    text = F.col(col)
    # everything that needs the text comes before the explode, so the text is not carried along with every word
    arrays = df.select(
        key, punctuation_emphasis(text).alias("emphasis"), scored_tokens(text, up, down, negations).alias("_tokens")
    )
    rows = arrays.select(key, "emphasis", F.inline_outer("_tokens"))
    known = lookup(rows, lexicon.select("word", "valence"), ["word"], F.struct(key, "i"))
    return with_token_valence(known).select(key, "i", "word", F.col("value").alias("valence"), "emphasis")


def polarity(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """(key, compound, pos, neg, neu) per text; NULL text scores 0, 0, 0, 1 and text without words all 0.

    Words are summed per text inside each task first, so one short row per text is shuffled.
    """
    words = word_scores(df, key, col, lexicon)
    v = F.col("valence")
    sums = words.groupBy(key).agg(
        # nine decimals: which side prevails must not hang on the order of a sum
        F.round(F.sum(v), 9).alias("_sum"),
        F.round(F.sum(F.when(v > 0, v + 1).otherwise(0.0)), 9).alias("_pos"),
        F.round(F.sum(F.when(v < 0, v - 1).otherwise(0.0)), 9).alias("_neg"),
        F.count_if(v == 0).alias("_zero"),
        F.count("word").alias("_words"),
        F.max("emphasis").alias("_emph"),
    )
    # the emphasis is NULL for NULL text only
    s = F.col("_sum") + F.when(F.col("_sum") > 0, F.col("_emph")).when(F.col("_sum") < 0, -F.col("_emph")).otherwise(0.0)
    staged = sums.select(
        key,
        "_words",
        F.col("_emph").isNull().alias("_missing"),
        (s / F.sqrt(s * s + V.NORMALISER)).alias("_c"),
        (F.col("_pos") + F.when(F.col("_pos") > F.abs("_neg"), F.col("_emph")).otherwise(0.0)).alias("_p"),
        F.abs(F.col("_neg") - F.when(F.col("_pos") < F.abs("_neg"), F.col("_emph")).otherwise(0.0)).alias("_n"),
        F.when(F.col("_words") > 0, F.col("_zero")).otherwise(0).alias("_z"),
    )
    total = F.col("_p") + F.col("_n") + F.col("_z")
    share = lambda c: F.when(F.col("_words") > 0, F.round(c / total, 3)).otherwise(0.0)
    return staged.select(
        key,
        F.when(F.col("_words") > 0, F.round("_c", 4)).otherwise(0.0).alias("compound"),
        share(F.col("_p")).alias("pos"),
        share(F.col("_n")).alias("neg"),
        F.when(F.col("_words") > 0, F.round(F.col("_z") / total, 3)).when(F.col("_missing"), 1.0).otherwise(0.0).alias("neu"),
    )


def labelled_polarity(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    return polarity(df, key, col, lexicon).withColumn("label", SC.polarity_label(F.col("compound")))


def pattern_sentiment(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """(key, polarity, subjectivity, label): means over the words found in lexicon (word, polarity, subjectivity)."""
    rows = df.select(key, F.posexplode_outer(F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))).alias("i", "word"))
    known = lookup(rows, lexicon, ["word"], F.struct(key, "i"))
    means = known.groupBy(key).agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"), F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity")
    )
    return means.withColumn("label", F.when(F.col("polarity") > 0.2, "positive").otherwise("negative"))


def sentence_sentiment(df: DataFrame, key: str, col: str, dictionary: DataFrame) -> DataFrame:
    """(key, sentence, label): sign of positive minus negative words per sentence; 0 counts as positive.

    ``dictionary`` has (word, label) with label positive or negative. Sentences without a known word give no row.
    """
    sentences = unnest(df, [key], T.sentences(F.col(col)), "_s", "sentence")
    rows = unnest(sentences, [key, "sentence"], T.normalise_tokens(T.tokens(F.col("_s"))), "word")
    signed = dictionary.select("word", F.when(F.col("label") == "positive", 1).otherwise(-1).alias("_sign"))
    hits = lookup(rows, signed, ["word"], F.struct(key, "sentence"), how="inner")
    return hits.groupBy(key, "sentence").agg(F.when(F.sum("_sign") >= 0, "positive").otherwise("negative").alias("label"))


def dictionary_sentiment(df: DataFrame, key: str, col: str, dictionary: DataFrame) -> DataFrame:
    """(key, sentiment): label of the first sentence that has one, else ``na``."""
    first = sentence_sentiment(df, key, col, dictionary).groupBy(key).agg(F.min_by("label", "sentence").alias("_first"))
    return df.select(key).join(first, key, "left").select(key, F.coalesce("_first", F.lit("na")).alias("sentiment"))


def sentence_and_word_rows(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """(key, i, word, score): the whole text as row −1, then every word with its own score."""
    whole = polarity(df, key, col, lexicon).select(key, F.lit(-1).alias("i"), F.lit(None).cast("string").alias("word"), F.col("compound").alias("score"))
    v = F.col("valence").cast("double")
    words = lookup(
        unnest(df, [key], T.words(F.col(col)), "raw", "i").withColumn("word", F.lower(F.regexp_replace("raw", f"^{EDGE}|{EDGE}$", ""))),
        lexicon.select("word", "valence"), ["word"], F.struct(key, "i"),
    )
    single = words.select(key, "i", "word", F.round(F.coalesce(v / F.sqrt(v * v + V.NORMALISER), F.lit(0.0)), 4).alias("score"))
    return whole.unionByName(single)


def sentiment_columns(df: DataFrame, key: str, cols: Sequence[str], lexicon: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Scores of several text columns side by side, names prefixed by the column.

    All columns go through one scoring pass as (key, column) rows and come back by one aggregation.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_text")) for c in cols])
    stacked = df.select(key, F.inline(entries)).withColumn("_id", F.struct(key, "_col"))
    scored = polarity(stacked, "_id", "_text", lexicon).select("_id.*", "compound", "pos", "neg", "neu")
    names = ["compound", "pos", "neg", "neu"]
    wide = scored.groupBy(key).agg(
        *[F.max(F.when(F.col("_col") == c, F.col(n))).alias(f"{c}_{n}") for c in cols for n in names]
    )
    out = wide.select("*", *[SC.polarity_label(F.col(f"{c}_compound")).alias(f"{c}_label") for c in cols])
    if dictionary is not None:
        labels = dictionary_sentiment(stacked, "_id", "_text", dictionary).select("_id.*", "sentiment")
        by_key = labels.groupBy(key).agg(*[F.max(F.when(F.col("_col") == c, F.col("sentiment"))).alias(f"{c}_sentiment") for c in cols])
        out = out.join(by_key, key)
    return out


def sentiment_table(df: DataFrame, key: str, cols: Sequence[str], lexicon: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``df`` with, for each text column c, its scores and label, the labels of its sentences in order, and its tokens.

    Added are c_compound, c_pos, c_neg, c_neu, c_label, c_sentiment (of the first sentence with a label, else na), c_sentence_labels and c_tokens;
    sentences without a known word have no label. ``key`` is unique in ``df``; all columns go through the scoring together.
    """
    scores = sentiment_columns(df, key, cols, lexicon)
    entries = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).alias("_text")) for c in cols])
    stacked = df.select(key, F.inline(entries)).withColumn("_id", F.struct(key, "_col"))
    labels = sentence_sentiment(stacked, "_id", "_text", dictionary).select("_id.*", "sentence", "label")
    ordered = lambda c: F.array_sort(F.collect_list(F.when(F.col("_col") == c, F.struct("sentence", "label"))))
    by_key = labels.groupBy(key).agg(*[F.transform(ordered(c), lambda x: x["label"]).alias(f"{c}_sentence_labels") for c in cols])
    none = F.array().cast("array<string>")
    wide = df.join(scores, key, "left").join(by_key, key, "left")
    wide = wide.withColumns({f"{c}_sentence_labels": F.coalesce(f"{c}_sentence_labels", none) for c in cols})
    wide = wide.withColumns({f"{c}_sentiment": F.coalesce(F.get(f"{c}_sentence_labels", 0), F.lit("na")) for c in cols})
    return wide.withColumns({f"{c}_tokens": F.coalesce(T.normalise_tokens(T.tokens(F.col(c))), none) for c in cols})


def word_distribution(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """(key, label, n, words): words of each text by the label of their own score, in text order."""
    rows = unnest(df, [key], T.normalise_tokens(T.tokens(F.col(col))), "word", "i")
    known = lookup(rows, lexicon.select("word", "valence"), ["word"], F.struct(key, "i"))
    v = F.coalesce(F.col("valence").cast("double"), F.lit(0.0))
    labelled = known.withColumn("label", SC.polarity_label(v / F.sqrt(v * v + V.NORMALISER)))
    return labelled.groupBy(key, "label").agg(
        F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda p: p["word"]).alias("words")
    )


def sentiment_records(df: DataFrame, key: str, patient: str, text: str, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) for records: label, scores and preview per record, one error row per bad record."""
    ok, errors = route(df, record_problem(patient, text))
    scored = labelled_polarity(ok, key, text, lexicon)
    results = ok.select(key, patient, T.preview(F.col(text)).alias("text_preview")).join(scored, key)
    return results, errors.select(key, patient, "error")
