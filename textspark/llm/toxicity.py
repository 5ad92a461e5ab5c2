"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Texts are folded first: case, accents, look-alike letters of other scripts, and digits and signs that stand
for letters. Lexicon terms are words and beginnings of words with the log odds of their being in
labelled toxic rows; phrases of a given list void the terms inside them. The weights matched and
the number of words give the score, by a logistic whose exponent of the length is fitted.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import arrow_map, fold, query, table, with_columns, written

SAMPLE = 4000  # labelled rows of each class to learn the terms from
TERMS = 2000  # the most that a lexicon has
SHORT, LONG = 4, 9  # letters of beginnings of words
LEAST_ROWS = 0.004  # share of the toxic sample that has a term, and 8 rows at least
LEAST_WEIGHT = 2.0
THRESHOLD = 0.3
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "white trash can", "sore loser rule")

# Letters of other scripts that look like Latin ones, and signs used for letters.
LOOK_ALIKE = dict(zip("абвгдеёзикмнопрстухуіјѕԁɡɩοαεικνρτυχηωβ", "abbrdeeeukmhonpctyxyijsdgioaeikvptuxnwb", strict=True))
STANDS_FOR = dict(zip("0134578@$!|", "oieastbasii", strict=True))


class Folding(dict):
    """Character table, filled as characters are met: a letter, or a blank."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", LOOK_ALIKE.get(c, STANDS_FOR.get(c, c))).lower()
        self[code] = out = "".join(LOOK_ALIKE.get(x, x) for x in base if x.isalpha()) or ("" if unicodedata.category(c) in ("Mn", "Cf") else " ")
        return out


FOLDING = Folding()
SIGNS = re.compile(r"(?<![^\W\d_])[!|]+|[@$!|]+(?![^\W\d_])|(?<![\w@$!|])\d+(?![\w@$!|])")


def folded(text: str) -> str:
    """Words in plain letters, each with one blank before and after; signs count as letters before a letter only."""
    return f" {' '.join(SIGNS.sub(' ', text.lower()).translate(FOLDING).split())} "


def terms(text: str) -> set[str]:
    """Words and their beginnings, with a blank before, and after a whole word."""
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORT, min(LONG, len(w) - 1) + 1))
    return out


class Lexicon:
    """Terms with weights, exception phrases, and the automaton of both."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str]):
        self.weights, self.automaton = weights, ahocorasick.Automaton()
        for t, w in weights.items():
            self.automaton.add_word(t, (len(t), w))
        for phrase in exceptions:
            t = folded(phrase)
            self.automaton.add_word(t, (len(t), 0.0))
        self.automaton.make_automaton()

    def __getstate__(self):
        return self.weights, [(k, v) for k, v in self.automaton.items()]

    def __setstate__(self, state):
        self.weights, items = state
        self.automaton = ahocorasick.Automaton()
        for k, v in items:
            self.automaton.add_word(k, v)
        self.automaton.make_automaton()

    def match(self, text: str) -> tuple[float, int, list[str]]:
        """Sum of the greatest weight in each word that no exception covers, number of words, terms matched."""
        body = folded(text)
        n = body.count(" ") - 1
        if len(self.automaton) == 0:
            return 0.0, max(0, n), []
        best: dict[int, tuple[float, str]] = {}
        void: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(body):
            start = end - size + 1
            if not weight:
                void.append((start, end))
            elif weight > best.get(start, (0.0, ""))[0]:
                best[start] = weight, body[start : end + 1]
        hits = [h for at, h in best.items() if not any(a <= at < b for a, b in void)] if void else list(best.values())
        return sum(w for w, _ in hits), max(0, n), sorted(t.strip() for _, t in hits)


# ---------------------------------------------------------------- learning


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of at most ``SAMPLE`` ids of each class outside the fold, those with the smallest hashes; and how many ids one of a class stands for."""
    known = labels.where((fold(F.col("doc_id"), folds) != held) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = written(known.withColumn("h", F.xxhash64("doc_id")), "labels")
    stands = {int(r["y"]): max(1.0, r["count"] / SAMPLE) for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(SAMPLE) for y in (0, 1)]
    return docs.join(F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", "y")), "doc_id"), stands  # 2 * SAMPLE labels at most


def learnt(rows: DataFrame) -> dict[str, float]:
    """Weights of the terms that tell toxic rows from others."""

    def run(batch):
        seen = {0: Counter(), 1: Counter()}
        n = Counter()
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[y].update(terms(t or ""))
            n[y] += 1
        names = [*dict.fromkeys([*seen[0], *seen[1]]), ""]  # the empty term counts rows
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array([seen[y].get(t, 0) if t else n[y] for t in names], pa.int64()) for y in (0, 1)]], ["term", "n0", "n1"])

    counts = arrow_map(rows.select("text", F.col("y").cast("int").alias("y")), run, "term string, n0 long, n1 long", rows=None).groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.where((F.col("n1") >= 8) | (F.col("term") == "")).persist()
    total = counts.where(F.col("term") == "").first()
    every = rows.groupBy("y").count().collect()
    n = {int(r["y"]): r["count"] for r in every}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1 or total is None:
        counts.unpersist()
        return {}
    weight = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    good = counts.where((F.col("term") != "") & (F.col("n1") >= max(8, LEAST_ROWS * n1))).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    picked = good.orderBy(F.desc(F.col("w") * F.sqrt("n1")), "term").limit(TERMS).collect()
    counts.unpersist()
    rows_of, longer = {r["term"]: r["n1"] for r in picked}, Counter()
    for t in rows_of:
        for k in range(2, len(t)):
            longer[t[:k]] = max(longer[t[:k]], rows_of[t])
    out: dict[str, float] = {}
    for r in sorted(picked, key=lambda r: (len(r["term"]), r["term"])):
        # a longer term in as many rows says the same more narrowly; one that adds little to its beginning says nothing new
        if longer[r["term"]] < 0.9 * r["n1"] and not any(out.get(r["term"][:k], -9.0) >= r["w"] - 0.5 for k in range(2, len(r["term"]))):
            out[r["term"]] = float(r["w"])
    return out


def logistic(x: np.ndarray, y: np.ndarray, stands: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method; x with a column of ones, ``stands`` with how many rows each stands for."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (stands * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (stands * (y - p)) - ridge * w)
    return w


def inputs(weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One, the weight matched, its density, and both against the length."""
    return np.stack([np.ones(len(n)), np.log1p(weight), np.log1p(100 * weight / np.maximum(n, 1)), (weight > 0) * np.log1p(n)], 1)


def classified(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, doc_id: str = "doc_id", text: str = "text", exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """(doc_id, held_out, score, predicted, weight, n_words, matched) for each row.

    Terms are learnt from at most ``SAMPLE`` labelled rows of each class outside fold ``held``, the
    logistic from the same rows, weighted so that each class counts as it does among all labels;
    one label, the largest, for an id. Null and empty texts match
    nothing and get the score of that; rows with a null id are scored, not learnt from; without
    labels of both classes all scores are 0.5.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows, stands = labelled(plain, labels, label, folds, held)
    rows = rows.persist()
    lexicon = Lexicon(learnt(rows), exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(column):
        found = [shared.value.match(t or "") for t in column.to_pylist()]
        return {"weight": pa.array([f[0] for f in found], pa.float64()), "n_words": pa.array([f[1] for f in found], pa.int64()), "matched": pa.array([f[2] for f in found], pa.list_(pa.string()))}

    names = {"weight": "double", "n_words": "long", "matched": "array<string>"}
    seen = with_columns(rows, F.col("text"), run, names).select("weight", "n_words", "y").toPandas()
    rows.unpersist()
    both = seen["y"].nunique() == 2
    weights = seen["y"].astype(int).map(stands).to_numpy(float)
    w = logistic(inputs(seen["weight"].to_numpy(), seen["n_words"].to_numpy()), seen["y"].to_numpy(float), weights).tolist() if both else [0.0] * 4
    a, n = F.col("weight"), F.col("n_words")
    z = F.lit(w[0]) + w[1] * F.log1p(a) + w[2] * F.log1p(100 * a / F.greatest(n, F.lit(1))) + w[3] * F.when(a > 0, F.log1p(n.cast("double"))).otherwise(0.0)
    out = with_columns(plain, F.col("text"), run, names).withColumn("score", 1 / (1 + F.exp(-z)))
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight", "n_words", "matched")


@query("op6_toxicity_lexicon")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 4, 2)
