"""Language identification with bit-sliced Bloom filters of character n-grams.

Learning keeps, for each language, the n-grams of words (with their ends marked) that enough of the language's sample
texts hold. The filters of all languages share their slots: slot i of the table is a bitmask of the languages whose
filter has bit i set (as many 64-bit words as the languages need), so the AND of an n-gram's few slots gives all the
languages that contain it at once. A text counts, for each language, the n-grams that its mask holds; from each count
goes the share of false positives that the filter's fill gives, and the language with the largest corrected share of
all n-grams wins; ties go to the language that sorts first. The score is that share's part of the sum over languages,
sharpened. The share itself, between 0 and 1, says how much of the text is in the language at all.

A null text, or one without a letter, is `und` with score and share 0, and so is every text where nothing was learned.
Documents without a language or a text teach nothing. Words are memoised within a worker, in a bounded table, so whole
texts cost one look-up a word. The n-grams of sample texts are counted on the workers; the driver gets only those that
a language keeps. Languages are taken to be thousands at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import TwoGenerations, begin, crc_mod, in_arrow, materialise, scored, table

#: Sample texts of a language, of any length.
SAMPLE = 400
SIZES = (2, 3, 4)
SLOTS, HASHES = 1 << 18, 3
#: Share of a language's sample texts that must hold an n-gram.
LEAST_SHARE = 0.02
#: A letter, and the letters and marks that follow it.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII_WORD = re.compile("[a-z]+")


def _words(text: str) -> list[str]:
    low = text.lower()
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def _grams(word: str) -> set[str]:
    w = f"<{word}>"
    return {w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)}


def text_grams(text: str) -> set[str]:
    """The distinct n-grams of a text's words."""
    return set().union(*map(_grams, set(_words(text))))


def _slots(gram: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(gram.encode("utf-8", "surrogatepass"))
    return [(h >> (32 * k)) % SLOTS for k in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # for each slot a mask of languages, in 64-bit words
    false: np.ndarray  # of each language, the share of false positives

    def masks(self, grams: list[str]) -> list[int]:
        words = np.bitwise_and.reduce(self.slots[[_slots(g) for g in grams]], axis=1)
        return [int.from_bytes(w.tobytes(), "little") for w in words]


def least_texts(n: int) -> float:
    """Of n sample texts, how many must hold an n-gram."""
    return max(2, LEAST_SHARE * n) if n > 4 else 1


def build(kept: dict[str, list[str]]) -> Filters:
    """Filters from the n-grams that each language keeps."""
    languages = sorted(kept)
    slots = np.zeros((SLOTS, max(1, -(-len(languages) // 64))), np.uint64)
    false = []
    for k, lang in enumerate(languages):
        used = np.array([s for g in kept[lang] for s in _slots(g)], np.int64)
        word, bit = k // 64, np.uint64(1 << k % 64)
        slots[used, word] |= bit
        false.append((np.count_nonzero(slots[:, word] & bit) / SLOTS) ** HASHES)
    return Filters(languages, slots, np.array(false))


def fit(samples: dict[str, list[str]]) -> Filters:
    """Filters of all languages from texts of each."""
    kept = {}
    for lang, texts in samples.items():
        counts = Counter(g for t in texts for g in text_grams(t))
        kept[lang] = [g for g, n in counts.items() if n >= least_texts(len(texts))]
    return build(kept)


#: Bits of a counter: a text's n-grams are fewer.
BITS = 40


class Scorer:
    """Counts of n-grams, those of all languages in one integer: a field for the n-grams, then one for each language."""

    def __init__(self, filters: Filters):
        self.f = filters
        self.gram = TwoGenerations(self._gram, 150_000)
        self.word = TwoGenerations(self._word, 120_000)

    def _gram(self, gram: str) -> int:
        mask, out, k = self.f.masks([gram])[0], 1, 1
        while mask:
            if mask & 1:
                out |= 1 << (BITS * k)
            mask, k = mask >> 1, k + 1
        return out

    def _word(self, word: str) -> int:
        """Of a stretch without white space: its n-grams, and how many of them each language holds."""
        return sum([self.gram[g] for w in _words(word) for g in _grams(w)])

    def shares(self, text: str | None) -> np.ndarray | None:
        """Each language's corrected share of the text's n-grams; null where there are none."""
        counts = sum(map(self.word.__getitem__, (text or "").split()))
        n, field = len(self.f.languages), (1 << BITS) - 1
        total = counts & field
        if not total or not n:
            return None
        hits = np.array([counts >> (BITS * (k + 1)) & field for k in range(n)], float)
        return np.clip((hits / total - self.f.false) / (1 - self.f.false), 0, 1)

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        share = self.shares(text)
        if share is None:
            return "und", 0.0, 0.0
        power = np.maximum(share, 1e-9) ** 8
        best = int(np.argmax(share))
        return self.f.languages[best], float(power[best] / power.sum()), float(share[best])


#: Times the rows that a sample needs that are ranked for it.
SPARE = 4


def _last_slots(slots: DataFrame, sizes: DataFrame, sample: int) -> DataFrame:
    """(lang, last): the slot of each language's row at place sample, by slot, or of its last row where there are fewer.

    Slots spread evenly, so a language of size rows has about SPARE * sample below that share of their range; only these
    are ranked, however large the table is. A language with too few there, as its rows repeat, is ranked whole.
    """
    spread = slots.join(F.broadcast(sizes), "lang")
    near = F.col("slot").cast("double") <= F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(float(SPARE * sample)) / F.col("size")) - F.lit(2.0**63)
    # each task keeps the first places of each language only
    place = F.row_number().over(Window.partitionBy("lang").orderBy("slot"))

    def last(some: DataFrame) -> DataFrame:
        return some.withColumn("n", place).where(F.col("n") <= sample).groupBy("lang").agg(F.max("slot").alias("last"), F.max("n").alias("n"))

    ranked = materialise(last(spread.where(near)).join(F.broadcast(sizes), "lang").where((F.col("n") >= sample) | (F.col("size") <= SPARE * sample)).select("lang", "last"))
    short = sizes.where(F.col("size") > SPARE * sample).join(F.broadcast(ranked), "lang", "left_anti").select("lang")
    if short.isEmpty():
        return ranked
    return ranked.unionByName(last(slots.join(F.broadcast(short), "lang")).select("lang", "last"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from the sample texts of each language whose ids and texts hash least, among rows whose crc32 remainder by 4 isn't 2.

    Rows that repeat an id and its text share a place in that order and all come in.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (crc_mod(F.col("id"), 4) != 2))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    rows = rows.where("text IS NOT NULL")
    slot = F.xxhash64(F.col("id"), F.col("text"))
    last = _last_slots(rows.select("lang", slot.alias("slot")), sizes, sample)
    # a row for each language
    chosen = rows.join(F.broadcast(last), "lang").where(slot <= F.col("last")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language")
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(batch.column(k) for k in (0, 1))):
                counts = found.setdefault(lang.as_py(), Counter())
                counts.update(text_grams(text.as_py()))
                counts[""] += 1  # the texts
        for lang, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    grams = in_arrow(chosen, run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language of more than four texts keeps no n-gram of one text
    texts = F.max(F.when(F.col("gram") == "", F.col("n"))).over(Window.partitionBy("lang"))
    least = F.when(F.col("texts") > 4, F.greatest(F.lit(2.0), F.col("texts") * LEAST_SHARE)).otherwise(1.0)
    kept: dict[str, list[str]] = {}
    for r in grams.withColumn("texts", texts).where(F.col("n") >= least).select("lang", "gram").collect():
        grams_of = kept.setdefault(r["lang"], [])
        if r["gram"]:
            grams_of.append(r["gram"])
    return build(kept)


def predict(
    docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score"), least_share: float | None = None
) -> DataFrame:
    """keep's columns (default: the id), the language and its score of every row, or of those of which at least least_share is in their language; in one pass without a shuffle.

    out names the two; neither may be one of keep. The filters are 2 MB of slots for each 64 languages.
    """

    def scorer(f: Filters):
        one = Scorer(f)
        return lambda texts: [one(t) for t in texts]

    columns = lambda got: [pa.array([x for x, _, _ in got], pa.string()), pa.array([x for _, x, _ in got], pa.float64())]
    choose = None if least_share is None else lambda got: np.array([x >= least_share for _, _, x in got], bool)
    return scored("language", docs, filters, scorer, text_col, keep or [id_col], {out[0]: "string", out[1]: "double"}, columns, choose)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
