"""Maximum-inner-product search with score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Vectors are cut into short subspaces of 16 codewords each. Codes and codewords are chosen to lower a loss that weighs
the residual along the vector (which moves the large inner products) more than the one across it. For every query a
table holds its inner product with each codeword; two subspaces' codes make one byte, so a vector's estimate is a sum
of look-ups by its bytes. The best estimates of each block are scored again on the original vectors, in double
precision, and with them all whose estimate is not further below the best found than the errors seen.

Queries are a stated set; rows and queries are dealt into blocks, and each pair of blocks is one task's work. Blocks
grow with the table, up to 65,536 rows, so that a vector is copied for each 65,536 queries only. Equal vectors of a
block are scanned once and bring their least ids. The codebook is fitted on a bounded sample, but every row is coded
and scanned.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths have no
inner product: each length is searched by itself (lengths are taken to be few). Components keep their type, so that
scores are those of the original vectors. Equal scores go to the smaller vec_id. Rows that repeat a vec_id count once,
with the vector that sorts first; rows without an id, or whose id isn't an integer, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import begin, bounded_sample, in_arrow, shared_model, table, worker_model

#: Rows that the codebook is fitted on.
SAMPLE = 4096
#: Components of a subspace, inner products (as a share of the largest) from which the loss is to be small.
WIDTH, THRESHOLD = 2, 0.2
#: Rows and queries of a block: so many at least, and a share of all of them up to so many.
LEAST_ROWS, LEAST_QUERIES, MOST, SHARE = 4096, 2048, 65_536, 64
#: Vectors of a block that are scored exactly for each query, at least.
RERANK = 192


@dataclass
class Codebook:
    words: np.ndarray  # subspaces x 16 x WIDTH
    weight: float  # of the residual along a vector, over that across it
    scale: float = 1.0  # brings vectors of any magnitude near 1, as codes are found in single precision

    @property
    def padded(self) -> int:
        return self.words.shape[0] * WIDTH

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.padded), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), -1, WIDTH)

    def codes(self, x: np.ndarray, rounds: int = 2, start: np.ndarray | None = None) -> np.ndarray:
        """A code for each subspace: nearest ones first, then one subspace after another under the anisotropic loss."""
        s = self.split(x)
        norm = np.maximum((x.astype(np.float32) ** 2).sum(axis=1), 1e-20)
        m = s.shape[1]
        rows = np.arange(len(x))
        codes = np.zeros((len(x), m), np.uint8) if start is None else start.copy()
        along = np.zeros((len(x), m), np.float32)  # of each subspace, the residual's inner product with the vector
        far = np.empty((m, len(x), 16), np.float32)
        toward = np.empty((m, len(x), 16), np.float32)
        for k in range(m):
            r = s[:, k, None, :] - self.words[k][None]
            far[k], toward[k] = (r**2).sum(axis=2), (r * s[:, k, None, :]).sum(axis=2)
            if start is None:
                codes[:, k] = far[k].argmin(axis=1)
            along[:, k] = toward[k][rows, codes[:, k]]
        total = along.sum(axis=1)
        for _ in range(rounds):
            for k in range(m):
                rest = total - along[:, k]
                loss = far[k] + (self.weight - 1) * (rest[:, None] + toward[k]) ** 2 / norm[:, None]
                codes[:, k] = loss.argmin(axis=1)
                along[:, k] = toward[k][rows, codes[:, k]]
                total = rest + along[:, k]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        c = self.codes(np.clip(x * self.scale, -1e6, 1e6))
        return c[:, 0::2] | (c[:, 1::2] << 4)


def fit(x: np.ndarray, rounds: int = 6, seed: int = 5) -> Codebook:
    """Codewords by k-means, then rounds of codes and of codewords under the anisotropic loss."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    m = -(-d // WIDTH)
    m += m % 2
    weight = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = Codebook(np.zeros((m, 16, WIDTH), np.float32), weight, float(np.clip(1 / float(np.median(np.abs(x).max(axis=1))), 1e-100, 1e100)))
    x = np.clip(x * book.scale, -1e6, 1e6)
    s = book.split(x)
    norm = np.maximum((x.astype(np.float64) ** 2).sum(axis=1), 1e-20)
    for k in range(m):
        words = s[rng.integers(0, len(x), 16), k].copy()
        for _ in range(8):
            near = ((s[:, k, None, :] - words[None]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(near, minlength=16)
            for j in range(WIDTH):
                words[:, j] = np.where(n, np.bincount(near, s[:, k, j], 16) / np.maximum(n, 1), words[:, j])
            words[n == 0] = s[rng.integers(0, len(x), int((n == 0).sum())), k]
        book.words[k] = words
    codes = None
    lam = (weight - 1) / norm
    for _ in range(rounds):
        codes = book.codes(x, 1, codes)
        residual = s - book.words[np.arange(m), codes]
        along = (residual * s).sum(axis=2)
        total = along.sum(axis=1)
        for k in range(m):
            own = s[:, k].astype(np.float64)
            goal = total - along[:, k] + (own**2).sum(axis=1)
            for c in range(16):
                i = np.flatnonzero(codes[:, k] == c)
                if len(i):
                    left = len(i) * np.eye(WIDTH) + (own[i] * lam[i, None]).T @ own[i]
                    right = own[i].sum(axis=0) + (own[i] * (lam[i] * goal[i])[:, None]).sum(axis=0)
                    book.words[k, c] = np.linalg.solve(left, right)
    return book


def valid(vector: Column) -> Column:
    """Whether a vector takes part, but for its length."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & sound & F.exists(vector, lambda v: v != 0), F.lit(False))


def blocks(n: int, least: int) -> int:
    """Blocks that n rows are dealt into."""
    return max(1, -(-n // min(max(least, n // SHARE), MOST)))


def _search_cell(rows: list[tuple], queries: list[tuple], book: Codebook, k: int, kind: type) -> list[tuple[int, int, float]]:
    """(query, id, score) of each query's best k rows of the cell; rows: (id, vector as bytes, codes)."""
    rows = sorted(rows)
    ids = np.array([r[0] for r in rows], np.int64)
    # equal vectors once: the first of each, and where its ids are; they ascend
    first: dict[bytes, int] = {}
    group = np.array([first.setdefault(r[1], len(first)) for r in rows])
    lead = np.unique(group, return_index=True)[1]
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(lead) + 1))
    x = np.frombuffer(b"".join(rows[i][1] for i in lead), kind).reshape(len(lead), -1).astype(np.float64)
    codes = np.frombuffer(b"".join(rows[i][2] for i in lead), np.uint8).reshape(len(lead), -1)
    columns = [np.ascontiguousarray(codes[:, j]) for j in range(codes.shape[1])]
    out = []
    for at in range(0, len(queries), 128):
        part = queries[at : at + 128]
        q = np.frombuffer(b"".join(r[1] for r in part), kind).reshape(len(part), -1)
        tables = np.einsum("qmw,mcw->qmc", book.split(q * book.scale), book.words)
        # byte = first code + 16 * second code
        pairs = (tables[:, 0::2, None, :] + tables[:, 1::2, :, None]).reshape(len(part), -1, 256)
        estimate = np.zeros((len(part), len(lead)), np.float32)
        for j, c in enumerate(columns):
            estimate += pairs[:, j].take(c, axis=1)
        most = min(max(RERANK, 2 * k), len(lead))
        best = np.argpartition(-estimate, most - 1, axis=1)[:, :most] if most < len(lead) else np.tile(np.arange(len(lead)), (len(part), 1))
        for row, (query, _, _), near, guess in zip(q.astype(np.float64), part, best, estimate):
            score = (x[near] * row).sum(axis=1)  # the same for equal vectors, wherever they stand
            if most < len(lead):
                # a dense cluster has many estimates alike: all that may still be among the best k are scored too
                near_one = score * book.scale**2
                level = np.partition(near_one, -k)[-k] - np.quantile(near_one - guess[near], 0.95)
                more = np.setdiff1d(np.flatnonzero(guess >= level), near, assume_unique=True)
                near, score = np.concatenate([near, more]), np.concatenate([score, (x[more] * row).sum(axis=1)])
            found: list[tuple[float, int]] = []
            for g in np.lexsort((ids[lead[near]], -score)):
                if len(found) >= k and -found[-1][0] > score[g]:
                    break
                members = ids[order[bounds[near[g]] : bounds[near[g] + 1]]][: k + 1]
                found += [(-float(score[g]), int(i)) for i in members if i != query]
            out += [(query, i, -s) for s, i in sorted(found)[:k]]
    return out


_SCHEMA = "query_id bigint, rank int, vec_id bigint, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of largest inner product found for each row of which is_query (over the id, named vec_id) holds."""
    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(vectors[id_col].try_cast("bigint").alias("vec_id"), vectors[vector_col].cast(f"array<{kind}>").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.count_distinct("vec_id").alias("ids")).collect()
    found = [_search_length(rows.where(F.size("v") == x["d"]), x, is_query, k, kind, sample) for x in sorted(lengths) if x["q"]]
    if not found:
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    return reduce(DataFrame.unionByName, found)


def _search_length(rows: DataFrame, size: Row, is_query: Column, k: int, kind: str, sample: int) -> DataFrame:
    """The search among vectors of one length; size: how many there are, and how many queries."""
    spark = rows.sparkSession
    drawn = bounded_sample(rows, "vec_id", sample).collect()
    shared = shared_model(spark, fit(np.array([r["v"] for r in sorted(drawn)], np.float64)))
    dtype = np.float32 if kind == "float" else np.float64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("nearest")
        book = worker_model("nearest", shared, lambda b: b)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype).reshape(batch.num_rows, -1)
            columns = [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in book.packed(x)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "codes"])

    coded = in_arrow(rows, code, "vec_id bigint, v binary, codes binary")
    if size["ids"] < size["n"]:
        coded = coded.groupBy("vec_id").agg(F.min(F.struct("v", "codes")).alias("s")).select("vec_id", "s.v", "s.codes")
    row_blocks, query_blocks = blocks(size["n"], LEAST_ROWS), blocks(size["q"], LEAST_QUERIES)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = coded.withColumn("b", block(row_blocks, "row")).withColumn("q", every(query_blocks)).withColumn("kind", F.lit(0))
    asked = coded.where(is_query).withColumn("q", block(query_blocks, "query")).withColumn("b", every(row_blocks)).withColumn("kind", F.lit(1))
    cells = base.unionByName(asked).select("b", "q", "kind", "vec_id", "v", "codes")
    cells = cells.repartition(row_blocks * query_blocks, "b", "q").sortWithinPartitions("b", "q", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("nearest")
        book = worker_model("nearest", shared, lambda b: b)
        key, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                got = _search_cell(*held, book, k, dtype)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for b, q, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, q) != key:
                    yield from done()
                    key, held = (b, q), ([], [])
                held[part].append(tuple(row))
        yield from done()

    found = in_arrow(cells, run, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth id."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
