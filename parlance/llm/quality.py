"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

Each input has a weight and a short vector; a text's score adds, to the weights of its inputs, the inner products of
all pairs of their vectors, found in linear time as half of the square of the summed vectors less the sum of the
squared ones. Inputs are the distinct words of the text (hashed, each with the same value, of unit length together),
statistics of its structure (standardised and clipped), and metadata: its length in characters, words and lines.

A null text counts as empty and is scored like any other. Words are memoised within a worker, in a bounded table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import labelled
from parlance.llm.common import TwoGenerations, crc_mod, scored, table

MOD, HELD_OUT = 4, 2
THRESHOLD = 0.7
BUCKETS, FACTORS = 1 << 14, 6
EPOCHS, BATCH, RATE = 6, 64, 0.02

_buckets = TwoGenerations(lambda w: xxhash.xxh3_64_intdigest(w.lower()) % BUCKETS, 100_000)


def statistics(data: bytes, words: list[bytes], ids: np.ndarray, distinct: np.ndarray) -> list[float]:
    """Rates of the text's structure, then the logarithms of its lengths."""
    size, n = max(1, len(data)), max(1, len(words))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    space = c[9:14].sum() + c[32]
    high = c[128:].sum()
    signs = size - upper - lower - digits - space - high
    soft = c[[33, 63]].sum()
    plain = c[[44, 46, 39, 45]].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = float(np.mean(ids[1:] == ids[:-1])) if len(ids) > 1 else 0.0
    counts = np.bincount(np.unique(ids, return_inverse=True)[1]) if len(ids) else np.zeros(1)
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1)
    return [
        upper / size, digits / size, (signs - plain - soft) / size, soft / size, plain / size, high / size, space / size,
        upper / max(1, upper + lower), len(distinct) / n, repeat, float(counts.max()) / n, float(lengths.mean()), float((lengths <= 1).sum()) / n, float((lengths > 20).sum()) / n,
        len(set(lines)) / max(1, len(lines)), c[124] / n, c[35] / n, c[33] / n, c[37] / n, len(lines) / n,
        np.log1p(size), np.log1p(n), np.log1p(len(lines)),
    ]


def inputs(text: str | None) -> tuple[np.ndarray, list[float]]:
    """Buckets of the distinct words, and the statistics."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    ids = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    distinct = np.unique(ids)
    return distinct, statistics(data, words, ids, distinct)


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    weight: np.ndarray  # of buckets, then of statistics
    vector: np.ndarray

    def dense(self, rows: list[list[float]]) -> np.ndarray:
        return np.clip((np.array(rows, float) - self.mean) / self.scale, -4, 4)

    def odds(self, words: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        d = dense.shape[1]
        n = np.array([len(w) for w in words])
        w, v = self.weight[-d:], self.vector[-d:]
        linear = self.bias + dense @ w
        total, square = dense @ v, (dense**2) @ (v**2)
        full = np.flatnonzero(n)
        if len(full):
            ids = np.concatenate([words[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            x = 1 / np.sqrt(n[full])
            vectors = self.vector[ids]
            linear[full] += np.add.reduceat(self.weight[ids], starts) * x
            total[full] += np.add.reduceat(vectors, starts) * x[:, None]
            square[full] += np.add.reduceat(vectors**2, starts) * (x**2)[:, None]
        return linear + 0.5 * (total**2 - square).sum(axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        each = [inputs(t) for t in texts]
        return 1 / (1 + np.exp(-np.clip(self.odds([x[0] for x in each], self.dense([x[1] for x in each])), -30, 30)))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, in small batches."""
    rng = np.random.default_rng(seed)
    each = [inputs(t) for t, _ in rows] or [inputs("")]
    y = np.array([y for _, y in rows] or [1], float)
    raw = np.array([x[1] for x in each], float)
    d = raw.shape[1]
    p = (y.sum() + 1) / (len(y) + 2)
    m = Machine(raw.mean(axis=0), raw.std(axis=0) + 1e-6, float(np.log(p / (1 - p))), np.zeros(BUCKETS + d), rng.normal(0, 0.02, (BUCKETS + d, FACTORS)))
    dense = m.dense([x[1] for x in each])
    gw, gv = np.full(BUCKETS + d, 1e-2), np.full((BUCKETS + d, FACTORS), 1e-2)
    own = BUCKETS + np.arange(d)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            if not len(part):
                continue
            words = [each[i][0] for i in part]
            n = np.array([len(w) for w in words])
            ids = np.concatenate(words)
            row = np.repeat(np.arange(len(part)), n)
            x = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
            vectors = m.vector[ids]
            z, v = dense[part], m.vector[own]
            total = z @ v
            for f in range(FACTORS):
                total[:, f] += np.bincount(row, vectors[:, f] * x, len(part))
            odds = m.odds(words, z)
            err = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[part]) / len(part)
            m.bias -= 0.2 * float(err.sum())
            used, at = np.unique(ids, return_inverse=True)
            ex = err[row] * x
            steps_w = np.bincount(at, ex, len(used)) + 2e-4 * m.weight[used]
            gw[used] += steps_w**2
            m.weight[used] -= 0.5 * RATE * steps_w / np.sqrt(gw[used])
            for f in range(FACTORS):
                s = np.bincount(at, ex * (total[row, f] - vectors[:, f] * x), len(used)) + 2e-4 * m.vector[used, f]
                gv[used, f] += s**2
                m.vector[used, f] -= 0.25 * RATE * s / np.sqrt(gv[used, f])
            s = z.T @ err + 1e-4 * m.weight[own]
            gw[own] += s**2
            m.weight[own] -= 5 * RATE * s / np.sqrt(gw[own])
            s = z.T @ (err[:, None] * total) - (z**2).T @ err[:, None] * v + 1e-4 * v
            gv[own] += s**2
            m.vector[own] -= 2 * RATE * s / np.sqrt(gv[own])
    return m


def _forget() -> None:
    _buckets.forget()


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, out: str = "quality_score", least: float | None = None) -> DataFrame:
    """keep's columns (default: the id) and the score of every row, or of those of at least least; in one pass without a shuffle.

    out names the score; it must not be one of keep.
    """
    return scored("quality", docs, model, lambda m: m.score, text_col, keep or [id_col], {out: "double"}, lambda got: [pa.array(got, pa.float64())], None if least is None else lambda got: got >= least, _forget)


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine fitted on a bounded sample of the labelled documents whose crc32 remainder by 4 isn't 2."""
    return fit(labelled.sample(docs, labels, "quality", MOD, HELD_OUT))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), MOD) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
