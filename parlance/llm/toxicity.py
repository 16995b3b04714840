"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of lexicon words, their nearness to words of the second person, and rates of capitals,
punctuation and obfuscation (letters written as digits or signs, letters repeated or spaced out). The lexicon is
learned: words and beginnings of words that labelled toxic texts hold far more often than others do. A sample of
labelled rows is cut in three: one part gives the lexicon, one the trees, one the calibration.

To the isotonic value goes a hundredth of the trees' own probability, so that texts of one step still differ in score.

A null text counts as empty and is scored like any other. Words are memoised within a worker, in a bounded table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import labelled
from parlance.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from parlance.llm.common import TwoGenerations, crc_mod, scored, table

MOD, HELD_OUT = 5, 0
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted vosotros vuestro".split())
_DECODED = str.maketrans("013457@$!|", "oieastasil")
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(.)\1{2,}")
PREFIXES = (3, 4, 5, 6)
STRONG, WEAK, YOU, OBFUSCATED, CAPITALS, SINGLE = (1 << k for k in range(6))
#: Words between a lexicon word and one of the second person that still count as near.
NEAR = 5


def plain(word: str) -> str:
    """The word's letters in lower case, with signs read as the letters that they stand for and repeats cut to two."""
    low = word.lower()
    if any(c in "013457@$!|*" for c in low) and any(c.isalpha() for c in low):
        low = low.rstrip("!.,;:?").translate(_DECODED)
    return _REPEATED.sub(r"\1\1", "".join(_LETTERS.findall(low)))


def _terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def learn_lexicon(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Log odds of words and beginnings (marked by *) that are in toxic texts far more often than in others."""
    toxic, other, n = Counter(), Counter(), [0, 0]
    for text, y in rows:
        seen = set()
        for w in {plain(x) for x in text.split()}:
            seen.update(_terms(w))
        (toxic if y else other).update(seen)
        n[1 if y else 0] += 1
    least = max(3, 0.01 * n[1])
    odds = {t: math.log((k + 0.5) / (n[1] + 1)) - math.log((other[t] + 0.5) / (n[0] + 1)) for t, k in toxic.items() if t and k >= least}
    return {t: v for t, v in odds.items() if v >= 2.5}


class Words:
    """Flags of words, memoised."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.flags = TwoGenerations(self._flags, 150_000)

    def _flags(self, word: str) -> int:
        p = plain(word)
        odds = max((self.lexicon.get(t, 0.0) for t in _terms(p)), default=0.0) if p else 0.0
        letters = "".join(c for c in word if c.isalpha())
        inner = word.strip("!.,;:?\"'()[]")
        odd = bool(letters) and (any(c in "013457@$!|*" for c in inner) or bool(_REPEATED.search(word)))
        return (STRONG if odds >= 4 else WEAK if odds else 0) | YOU * (p in SECOND_PERSON) | OBFUSCATED * odd | CAPITALS * (len(letters) > 1 and letters.isupper()) | SINGLE * (len(p) == 1)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = len(words)
        flags = np.fromiter(map(self.flags.__getitem__, words), np.uint8, n)
        strong, weak = np.flatnonzero(flags & STRONG), np.flatnonzero(flags & WEAK)
        you = np.flatnonzero(flags & YOU)
        gap = n or 1
        near = 0
        if len(strong) and len(you):
            k = np.searchsorted(you, strong)
            left = np.abs(strong - you[np.maximum(k - 1, 0)])
            right = np.abs(you[np.minimum(k, len(you) - 1)] - strong)
            gaps = np.minimum(left, right)
            gap, near = int(gaps.min()), int((gaps <= NEAR).sum())
        chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
        size = max(1, len(text))
        per = max(1, n)
        capitals = chars[65:91].sum() / size
        marks = chars[[33, 63]].sum()
        signs = chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()
        return [
            len(strong) / per, float(len(strong)), len(weak) / per, float(len(weak)), len(you) / per, near / per, 1 / (1 + gap),
            (flags & OBFUSCATED != 0).sum() / per, (flags & CAPITALS != 0).sum() / per, (flags & SINGLE != 0).sum() / per,
            capitals, marks / size, signs / size, chars[48:58].sum() / size, math.log1p(n),
        ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    isotonic: Isotonic

    def score(self, words: Words, texts: list[str | None]) -> np.ndarray:
        x = np.array([words.features(t) for t in texts], float).reshape(len(texts), -1)
        return np.clip(self.isotonic(self.trees(x)), 0, 1) if len(texts) else np.zeros(0)


def fit(rows: list[tuple[str, int]]) -> Model:
    rows = rows or [("", 0)]  # nothing is labelled: every text scores low
    a, b = int(len(rows) * 0.45), int(len(rows) * 0.8)
    lexicon = learn_lexicon(rows[:a])
    words = Words(lexicon)
    x = np.array([words.features(t) for t, _ in rows[a:]], float)
    y = np.array([y for _, y in rows[a:]], float)
    cut = max(1, b - a)
    trees = fit_trees(x[:cut], y[:cut])
    return Model(lexicon, trees, fit_isotonic(trees(x[cut:]), y[cut:]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """keep's columns (default: the id) and the score of every row, in one pass without a shuffle. out names the score; it must not be one of keep."""

    def make(m: Model):
        words = Words(m.lexicon)
        return lambda texts: m.score(words, texts)

    return scored("toxicity", docs, model, make, text_col, keep or [id_col], {out: "double"}, lambda got: [pa.array(got, pa.float64())])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic", MOD, HELD_OUT))
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
