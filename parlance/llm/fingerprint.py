"""Document fingerprints by consistent weighted sampling.

A text's terms are its sequences of five words (as sets of near-duplicates take them; the whole sequence if there are
fewer words), weighted by how often they occur. Each of the samples draws, for every term, two gamma variables r and c
and a uniform one, beta, from a hash of the term and the sample; with t = floor(ln w / r + beta) it takes the term of
least a = c / (exp(r (t - beta)) exp(r)) and keeps that term together with t. Two texts keep the same in a sample with
a probability of their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.

The gamma variables come from tables of quantiles, of 2^16 steps each; a sample is kept as 32 bits of a hash.

Null texts count as empty; a text without words has a fingerprint of its own, alike to another such one alone.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import begin, in_arrow, table
from parlance.llm import minhash
from parlance.llm.minhash import mix, shingle_hashes, word_hashes

SAMPLES, WIDTH = 64, 5
#: Documents of a range of ids, and ranges at most: a range is read in blocks, so it may be of any size; beyond 16
#: million documents ranges grow, to some 300,000 of 10 billion.
RANGE, RANGES = 500, 1 << 15


@functools.lru_cache(maxsize=1)
def _gamma() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by Newton's method on its distribution function 1 - (1 + x) exp(-x)."""
    q = (np.arange(65536) + 0.5) / 65536
    x = np.where(q < 0.3, np.sqrt(2 * q), 1.5 - np.log1p(-q))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / (x * np.exp(-x)), 1e-6)
    return x.astype(np.float32)


@functools.lru_cache(maxsize=1)
def _log_gamma() -> np.ndarray:
    return np.log(_gamma())


_LOW, _S16, _S32, _HALF = np.uint64(0xFFFF), np.uint64(16), np.uint64(32), np.uint64(0xFFFFFFFF)
_STEP, _ONE, _SIGN = np.float32(1 / 65536), np.float32(1), np.int32(-(2**31))


def terms(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms, and their weights."""
    return np.unique(shingle_hashes(word_hashes(text), width), return_counts=True)


def _least(h: np.ndarray, w: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Of every stretch of terms (none empty) and each sample, the least offer: its size in the upper half, what is kept of it in the lower one."""
    r_table, c_table = _gamma(), _log_gamma()
    out = np.empty((len(starts), samples), np.uint64)
    many = np.flatnonzero(w > 1)
    log_w = np.log(w[many]).astype(np.float32)
    for s in range(samples):
        draw = mix(h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * s + 1)) % 2**64))
        r = r_table[(draw & _LOW).view(np.int64)]
        low = draw >> _S32
        beta = (low & _LOW).astype(np.float32) * _STEP
        # a term of weight 1 has t = 0
        a = c_table[((draw >> _S16) & _LOW).view(np.int64)] + r * (beta - _ONE)
        if len(many):
            t = np.floor(log_w / r[many] + beta[many])
            a[many] -= r[many] * t
            moved = np.flatnonzero(t)
            low[many[moved]] = mix(draw[many[moved]] + t[moved].astype(np.int64).view(np.uint64)) >> _S32
        # as an integer that sorts as the number does
        bits = a.view(np.int32)
        bits = (bits ^ ((bits >> 31) | _SIGN)).view(np.uint32)
        out[:, s] = np.minimum.reduceat((bits.astype(np.uint64) << _S32) | low, starts)
    return out


#: Terms that are drawn for at once, so that they stay in a processor's cache; a text's terms stay together.
TERMS = 1 << 15


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of at most TERMS terms, or of one entry."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > TERMS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _minima(parts: list[tuple[np.ndarray, np.ndarray]], samples: int) -> np.ndarray:
    """The least offers of each part's terms; of an empty part, the greatest number there is."""
    out = np.full((len(parts), samples), np.iinfo(np.uint64).max, np.uint64)
    full = [i for i, p in enumerate(parts) if len(p[0])]
    sizes = [len(parts[i][0]) for i in full]
    for lo, hi in _groups(sizes):
        starts = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]])
        h, w = (np.concatenate([parts[i][k] for i in full[lo:hi]]) for k in (0, 1))
        out[full[lo:hi]] = _least(h, w, starts, samples)
    return out


def _kept(least: np.ndarray) -> np.ndarray:
    """The samples: 32 bits of a hash of the term that is kept, with its t; zeros where there is no term."""
    return np.where(least == np.iinfo(np.uint64).max, 0, least & _HALF).astype(np.uint32)


def fingerprints(texts: list[str | None], samples: int = SAMPLES, width: int = WIDTH) -> np.ndarray:
    """A row of samples for each text."""
    return _kept(_minima([terms(t, width) for t in texts], samples))


def with_edited(texts: list[str], edited: list[str], samples: int = SAMPLES, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts and of edited, whose texts are forms of the first ones in order: terms that both forms hold alike are drawn once."""
    own = [terms(t, width) for t in texts]
    parts = []
    for (h, w), x, y in zip(own, texts, edited):
        g, v = terms(y, width) if x != y else (h, w)
        at = np.searchsorted(h, g)
        at[at == len(h)] = 0
        same = (h[at] == g) & (w[at] == v) if len(h) else np.zeros(len(g), bool)
        rest = np.ones(len(h), bool)
        rest[at[same]] = False
        parts += [(g[same], v[same]), (h[rest], w[rest]), (g[~same], v[~same])]
    n = len(edited)
    least = _minima(parts + own[n:], samples)
    both, first, second = (least[k : 3 * n : 3] for k in range(3))
    return _kept(np.concatenate([np.minimum(both, first), least[3 * n :]])), _kept(np.minimum(both, second))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x == y))


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, doc_id, text, last) in partitions and in order of ids, each range ending with a copy of the row after it.

    Ids are cut into ranges at approximate quantiles. last marks the copies; that of the last range is of the first
    row of all. Null ids stand first; equal ids stand in order of their texts. One shuffle of the texts.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n, ids = rows.select("doc_id"), None
    count = n.count()
    k = min(RANGES, max(1, -(-count // RANGE)))
    # bounds: one for each range, a few bytes each; the quantiles are finer than the ranges
    ids = n.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], max(10_000, 4 * k))).first()[0] if k > 1 else []
    bounds = sorted(set(ids or []))
    # two steps of look-up: the chunk of bounds, then the place in it
    chunks = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    below = lambda a: F.coalesce(F.size(F.filter(a, lambda b: b < F.col("doc_id"))), F.lit(0))
    chunk = below(F.lit([c[-1] for c in chunks])) if bounds else F.lit(0)
    place = chunk * 64 + below(F.get(F.lit(chunks), chunk)) if bounds else F.lit(0)
    placed = rows.withColumn("range", place.cast("int"))
    # the first row of each range goes to the range before it too
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))
    firsts = placed.groupBy("range").agg(F.min(order).alias("o")).orderBy("range").collect()
    if not firsts:
        return placed.withColumn("last", F.lit(False))
    ranges = [f["range"] for f in firsts]
    before = {r: ranges[i - 1] for i, r in enumerate(ranges)}
    heads = docs.sparkSession.createDataFrame([(f["range"], before[f["range"]], f["o"][1], f["o"][2]) for f in firsts], "range int, to int, head_id bigint, head_hash bigint")
    copies = placed.join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.xxhash64("text") == F.col("head_hash")))
    copies = copies.dropDuplicates(["range"]).select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("last"))
    both = placed.withColumn("last", F.lit(False)).unionByName(copies)
    parts = max(1, -(-len(ranges) // 3))
    return both.repartition(parts, "range").sortWithinPartitions("range", "last", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Of every document: its fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    edited: the last quarter of its characters gives way to as many of the next document's first ones.
    """
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", minhash.forget)
        held: list[tuple] = []  # rows of one range that wait for the next one

        def done(rows: list[tuple]) -> pa.RecordBatch:
            ids, texts = [r[1] for r in rows], [r[2] for r in rows]
            edited = []
            for x, y in zip(texts, texts[1:]):
                cut = len(x) // 4
                edited.append(x[: len(x) - cut] + y[:cut])
            own, other = with_edited(texts, edited, samples, width)
            same = own[:-1] == other, own[:-1] == own[1:]
            columns = [
                pa.array(ids[:-1], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]), pa.array([_hex(x) for x in own[:-1]]), pa.array([_hex(x) for x in other]),
                *(pa.array(x.mean(axis=1), pa.float64()) for x in same),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        size = 0
        for batch in batches:
            for r in zip(*(batch.column(k) for k in range(4))):
                r = tuple(x.as_py() for x in r)
                if held and r[0] != held[0][0]:
                    if len(held) > 1:
                        yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[2])
                if size > 2_000_000 and len(held) > 1:  # a block of the range; its last row begins the next block
                    yield done(held)
                    held, size = held[-1:], len(r[2])
        if len(held) > 1:
            yield done(held)

    return in_arrow(in_order(docs, id_col, text_col).select("range", "doc_id", "text", "last"), run, schema)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return with_next(table(spark, sf_dir, "documents"))
