"""Token counts by Viterbi alone: no pieces are made, only the best score and its number of pieces.

An Aho-Corasick automaton gives all vocabulary pieces that end at a character. Of equal scores the
piece that starts first wins, as in the public unigram tokenizers; a character that is no piece costs the
lowest score less 10 and is counted by its bytes. No piece has a blank after another
character, so words are counted one by one, and a word's count is kept.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textspark.llm.common import query, table, with_columns

BLANK = "▁"
PENALTY = 10.0
CACHE = 150_000
LONG = 64


class Unigram:
    """Vocabulary of pieces with scores; byte, control and unknown pieces match no text."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        joined = any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.word = re.compile(r"(?s).+" if joined else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, tuple[int, int]] = {}

    @classmethod
    def load(cls, path: str) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        return cls({p.id_to_piece(i): p.get_score(i) for i in plain})

    def best(self, word: str) -> tuple[int, int, float]:
        """Pieces, unknown characters and score of the best way to cut ``word``."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        if self.single.issuperset(word):  # each character is a piece, so each place is reached and none is unknown
            reached = 0
            for last, (size, value) in self.automaton.iter(word):  # longest first: of equal scores the first start wins
                s = score[last + 1 - size] + value
                if reached <= last or s > score[last + 1]:
                    reached = last + 1
                    score[reached], count[reached] = s, count[reached - size] + 1
            return count[n], 0, score[n]
        odd = [0] * (n + 1)
        done = 0

        def close(to: int) -> None:
            # characters that no piece ends at, up to ``to``, can only be unknown
            nonlocal done
            while done < to:
                unknown(done + 1)
                done += 1

        def unknown(end: int) -> None:
            c = word[end - 1]
            if c not in self.pieces:
                s = score[end - 1] + self.unknown
                if reached < end or s > score[end]:
                    score[end], count[end], odd[end] = s, count[end - 1] + len(c.encode("utf-8", "replace")), odd[end - 1] + 1

        reached = 0
        for last, (size, value) in self.automaton.iter(word):
            end = last + 1
            close(end - 1)
            s = score[end - size] + value
            if reached < end or s > score[end]:
                score[end], count[end], odd[end] = s, count[end - size] + 1, odd[end - size]
                reached = end
        close(n)
        return count[n], odd[n], score[n]

    def count(self, text: str) -> tuple[int, int]:
        """(pieces, unknown characters) of a text; a blank is set before it, none of an empty one."""
        if not text:
            return 0, 0
        total = odd = 0
        for word, times in Counter(self.word.findall(BLANK + text.replace(" ", BLANK))).items():
            found = self.known.get(word)
            if found is None:
                found = self.best(word)[:2]
                if len(word) <= LONG:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[word] = found
            total += found[0] * times
            odd += found[1] * times
        return total, odd


MODELS: dict[str, Unigram] = {}  # one for each path in a worker


def counted(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_pieces`` and ``n_unknown``; null and empty texts have none. Rows are independent of each other."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(column):
        if path not in MODELS:
            MODELS[path] = Unigram.load(path)
        found = [MODELS[path].count(t or "") for t in column.to_pylist()]
        return {"n_pieces": pa.array([f[0] for f in found], pa.int64()), "n_unknown": pa.array([f[1] for f in found], pa.int64())}

    return with_columns(docs, F.col(f"`{text}`").cast("string"), run, {"n_pieces": "long", "n_unknown": "long"})


@query("op9_viterbi_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
