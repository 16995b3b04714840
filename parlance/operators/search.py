"""Vector search over chunks, its filters, reranking by intent, and the parts of an answer."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from parlance.functions import text as T
from parlance.operators.stats import top

# What a query's words say of emotions to prefer, tried in order, and by how much.
INTENTS = (
    (r"\b(love|affection|romance|adore|cherish)\b", ("love", "joy"), 0.10),
    (r"\b(argue|argument|fight|conflict|angry|upset|mad)\b", ("anger", "sadness"), 0.10),
    (r"\b(sad|crying|grief|loss|miss|lonely)\b", ("sadness", "fear"), 0.10),
    (r"\b(happy|joy|excited|fun|laugh|funny)\b", ("joy",), 0.10),
    (r"\b(scared|afraid|worried|anxious|nervous)\b", ("fear",), 0.10),
    (r"\b(apolog|sorry|forgive)\b", ("sadness",), 0.05),
)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fit_length(v: Column, n: int) -> Column:
    """Cut or padded with zeros to n components."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


#: Chunks and queries of a cell, and components of either's vectors; queries that are compared at once, pairs that are scored at once.
ROWS, QUERIES, COMPONENTS, TOGETHER, PAIRS = 16_384, 2_048, 1 << 23, 128, 1 << 16
#: Similarities have so many digits; equal ones are at most one step of the last apart, and products of matrices err by far less than the rest.
DIGITS = 5
MARGIN = 10.0**-DIGITS + 1e-9


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (-1: null, empty or holding null, so without a similarity), starts, and all components in double precision."""
    v = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = v.flatten()
    gaps = np.repeat(np.arange(len(v)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]
    lengths = np.where(sizes == 0, -1, sizes)
    lengths[gaps] = -1
    return lengths, np.cumsum(sizes) - sizes, values.to_numpy(zero_copy_only=False).astype(np.float64)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows, added up in the order of components, as dot() does."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[:, j]
    return out


def _leads(k: int, *keys: np.ndarray) -> np.ndarray:
    """Which rows are among the first k of their run of equal keys."""
    at = np.arange(len(keys[0]))
    new = np.ones(len(at), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    return at - np.maximum.accumulate(np.where(new, at, 0)) < k


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of those that may be among their query's first k by the rounded score, then by row."""
    steps = score * 10.0**DIGITS
    unsure = np.abs(steps - np.floor(steps) - 0.5) < 1e-4  # Spark alone rounds those
    level = np.where(np.isnan(score), np.inf, np.where(np.isposinf(score), 1e300, np.rint(steps)))
    sure, rest = np.flatnonzero(~unsure), np.flatnonzero(unsure)
    sure = sure[np.lexsort((row[sure], -level[sure], query[sure]))]
    rest = rest[np.lexsort((row[rest], score[rest], query[rest]))]
    return np.concatenate([sure[_leads(k, query[sure])], rest[_leads(k, query[rest], score[rest])]])


def _pairs(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and cosine of those that may be among the k rows of x nearest to a query of y; earlier rows win ties.

    Products of matrices say which rows are near enough; those are scored as cosine() does. Equal vectors count once.
    """
    _, lead, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(len(lead) + 1))
    x = x[lead]
    nx, ny = np.sqrt(_dots(x, x)), np.sqrt(_dots(y, y))
    # what is zero, not finite or out of all proportion is scored with everything
    unit = [np.where(((n > 1e-100) & (n < 1e100))[:, None], v / n[:, None], np.nan) for v, n in ((x, nx), (y, ny))]
    found = []
    for at in range(0, len(y), TOGETHER):
        near = unit[1][at : at + TOGETHER] @ unit[0].T
        loose = np.isnan(near)
        near[loose] = -np.inf
        if k < len(lead):
            loose |= near >= np.partition(near, len(lead) - k, axis=1)[:, len(lead) - k, None] - MARGIN
        else:
            loose[:] = True
        q, g = np.nonzero(loose)
        q += at
        score = np.empty(len(q))
        for i in range(0, len(q), PAIRS):
            a, b = g[i : i + PAIRS], q[i : i + PAIRS]
            score[i : i + PAIRS] = _dots(x[a], y[b]) / (nx[a] * ny[b])
        copies = np.minimum(bounds[g + 1] - bounds[g], k)
        place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        q, row, score = np.repeat(q, copies), order[np.repeat(bounds[g], copies) + place], np.repeat(score, copies)
        best = _best(q, row, score, k)
        found.append((q[best], row[best], score[best]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What of a cell's chunks may be among the k nearest to each of its queries."""

    def run(c: pa.Table, queries: pa.Table) -> pa.Table:
        c = c.take(pc.sort_indices(c, sort_keys=[("chunk_index", "ascending")], null_placement="at_start"))
        lengths, starts, values = _vectors(c["embedding"])
        asked_lengths, asked_starts, asked_values = _vectors(queries["query"])
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
        for d in np.unique(asked_lengths):
            own, rows = np.flatnonzero(asked_lengths == d), np.flatnonzero((lengths == d) & (d >= 0))
            if len(rows):
                with np.errstate(all="ignore"):
                    q, r, score = _pairs(values[starts[rows][:, None] + np.arange(d)], asked_values[asked_starts[own][:, None] + np.arange(d)], k)
                found.append((own[q], rows[r], score, np.zeros(len(q), bool)))
            if len(rows) < k:  # then chunks without a similarity follow
                rest = np.flatnonzero((lengths != d) | (d < 0))[:k]
                found.append((np.repeat(own, len(rest)), np.tile(rest, len(own)), np.zeros(len(own) * len(rest)), np.ones(len(own) * len(rest), bool)))
        q, r, score, none = (np.concatenate(x) for x in zip(*found))
        left, right = c.drop_columns(["embedding", *_CELL]).take(r), queries.drop_columns(["upload_id", "query", *_CELL]).take(q)
        return pa.table([*left.columns, *right.columns, pa.array(score, mask=none)], names=[*left.column_names, *right.column_names, "similarity"])

    return run


_CELL = ["_rows", "_queries"]


def _blocks(df: DataFrame, vector: str, most: int, name: str) -> DataFrame:
    """Into how many blocks each conversation's rows are dealt."""
    size = df.groupBy("upload_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("components"))
    return size.select("upload_id", F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("components") / COMPONENTS)).cast("int").alias(name))


def nearest(c: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's k chunks of largest cosine within its conversation; queries: query_id, upload_id, query (a vector).

    Chunks and queries of a conversation are dealt into blocks, each pair of blocks is one cell, and each cell keeps
    k of each query. Equal cosines go to the smaller chunk_index. Chunks without one (no vector, null in it, another
    length) come last; a vector of zeros has no direction, its cosine is NaN, which counts as the largest, as in SQL.
    Both tables' columns stay, but for the vectors.
    """
    c, queries = c.where("upload_id IS NOT NULL"), queries.where("upload_id IS NOT NULL")
    blocks = _blocks(c, "embedding", ROWS, "_n_rows").join(_blocks(queries, "query", QUERIES, "_n_queries"), "upload_id")
    # one row for each full block at most
    large = F.broadcast(blocks.where("_n_rows > 1 OR _n_queries > 1"))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    sides = []
    for df, key, own, other in ((c, "chunk_index", *_CELL), (queries, "query_id", *reversed(_CELL))):
        dealt = df.join(large, "upload_id", "left").withColumn(own, block(key, F.col(f"_n{own}"))).withColumn(other, every(F.col(f"_n{other}")))
        # columns of their own, as the queries may be rows of the same table
        sides.append(dealt.select(*[F.col(x).alias(x) for x in (*df.columns, *_CELL)]).groupBy("upload_id", *_CELL))
    kept = [f for f in c.schema if f.name != "embedding"] + [f for f in queries.schema if f.name not in ("upload_id", "query")]
    found = sides[0].cogroup(sides[1]).applyInArrow(_cell(k), StructType(kept).add("similarity", DoubleType()))
    return top(found.withColumn("similarity", F.round("similarity", DIGITS)), ["query_id"], k, F.desc("similarity"), "upload_id", "chunk_index")


def filters(sender=None, date_from=None, date_to=None, emotion=None, sentiment=None, msg_type=None) -> Column:
    """The conjunction of those that are given."""
    out = F.lit(True)
    for value, cond in (
        (sender, lambda v: F.col("sender") == v), (date_from, lambda v: F.col("timestamp") >= F.lit(v)), (date_to, lambda v: F.col("timestamp") <= F.lit(v)),
        (emotion, lambda v: F.col("emotion_label") == v), (sentiment, lambda v: F.col("sentiment_label") == v), (msg_type, lambda v: F.col("msg_type") == v),
    ):
        if value is not None:
            out = out & cond(value)
    return out


def search(c: DataFrame, m: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.3, where: Column | None = None) -> DataFrame:
    """Chunks near each query with the message that stands for each: more are fetched than asked for, then filtered."""
    hits = nearest(c, queries, max(3 * k, k + 20)).where(F.col("similarity") >= least)
    places = hits.select("query_id", "upload_id", "chunk_index", "similarity", F.explode(F.sequence("start_msg_index", "end_msg_index")).alias("msg_index"))
    rows = places.join(m if where is None else m.where(where), ["upload_id", "msg_index"])
    rows = rows.withColumn("text", F.trim(F.coalesce(F.when(F.col("content_english") != "", F.col("content_english")), F.col("content"))))
    w = Window.partitionBy("query_id", "upload_id", "chunk_index")
    rows = rows.withColumns({"place": F.row_number().over(w.orderBy("msg_index")) - 1, "mid": F.floor(F.count("*").over(w) / 2)})
    far = F.struct((F.length("text") < 4).alias("short"), F.abs(F.col("place") - F.col("mid")).alias("d"), (F.col("place") < F.col("mid")).alias("before"))
    best = rows.groupBy("query_id", "upload_id", "chunk_index", "similarity").agg(F.min_by(F.struct("msg_index", "sender", "emotion_label"), far).alias("anchor"))
    out = top(best, ["query_id"], k, F.desc("similarity"), "chunk_index")
    return out.select("query_id", "rank", "upload_id", "chunk_index", "similarity", F.col("anchor.msg_index").alias("anchor_index"), F.col("anchor.sender").alias("sender"), F.col("anchor.emotion_label").alias("emotion_label"))


def similar_to(c: DataFrame, msg_index: int, upload_id: int, k: int = 10) -> DataFrame:
    """Chunks nearest to the first chunk that holds a message, without that one."""
    own = c.where((F.col("upload_id") == upload_id) & (F.col("start_msg_index") <= msg_index) & (F.col("end_msg_index") >= msg_index) & F.col("embedding").isNotNull())
    q = own.orderBy("chunk_index").limit(1).select(F.lit(0).alias("query_id"), "upload_id", F.col("embedding").alias("query"), F.col("chunk_index").alias("own"))
    rows = c.join(q, "upload_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("query")), 5))
    hits = top(rows, ["query_id"], k + 5, F.desc("similarity"), "upload_id", "chunk_index")
    return top(hits.where("chunk_index <> own").drop("rank"), ["query_id"], k, F.desc("similarity"), "chunk_index").select("rank", "upload_id", "chunk_index", "similarity")


def intent(query: str) -> tuple[tuple[str, ...], float]:
    for pattern, emotions, boost in INTENTS:
        if re.search(pattern, query, re.I):
            return emotions, boost
    return (), 0.0


def rerank(hits: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Hits whose emotion the query prefers move up; equal ones keep their order."""
    emotions, boost = intent(query)
    score = F.when(F.col("emotion_label").isin(*emotions), F.least(F.lit(1.0), F.col("similarity") + boost)).otherwise(F.col("similarity")) if emotions else F.col("similarity")
    rows = hits.withColumn("score", F.round(score, 5)).withColumnRenamed("rank", "first_rank")
    return top(rows, ["query_id"], k, F.desc("score"), "first_rank")


def confidence(hits: DataFrame, synthesised: bool = False) -> DataFrame:
    return hits.groupBy("query_id").agg(F.least(F.lit(1.0), F.max("similarity") + (0.1 if synthesised else 0.0)).alias("confidence"))


def citations(answer: Column) -> Column:
    """Ids that an answer cites in brackets."""
    return F.regexp_extract_all(answer, F.lit(r"\[(msg_[\w\-]+)\]"), F.lit(1))


def keyword_rich(query: Column, least: int = 5) -> Column:
    """Whether a query has enough distinct words that are no stopwords."""
    words = F.filter(F.array_distinct(T.tokens(query)), lambda w: ~w.isin(*T.CONTENT_STOPWORDS))
    return F.size(words) >= least


# What to ask, as it is shown, as it is searched, and its kind.
SUGGESTIONS = (
    ("What do we argue about?", "What are the most common reasons we argue or disagree?", "relationship"),
    ("How does affection show up?", "How does each person express affection or love in the conversation?", "relationship"),
    ("Happiest moments", "Which conversations stand out as the happiest or most fun?", "moments"),
    ("When did things change?", "When did the communication patterns change, and how?", "patterns"),
    ("Most discussed topics", "What topics do we discuss most often?", "content"),
    ("How do we apologize?", "How does each person apologize, and how is it received?", "relationship"),
    ("Plans we made", "What plans did we make together — trips, events, ideas?", "content"),
    ("Inside jokes", "What are the recurring jokes, references, or shared phrases?", "content"),
)


def suggestions(spark) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SUGGESTIONS, 1)], "place int, label string, query string, category string")


def newest_first(hits: DataFrame, m: DataFrame) -> DataFrame:
    """Hits of a search in the order of their messages' times, the newest first."""
    times = m.select("upload_id", F.col("msg_index").alias("anchor_index"), "timestamp")
    w = Window.partitionBy("query_id").orderBy(F.desc("timestamp"), "first_rank")
    rows = hits.withColumnRenamed("rank", "first_rank").join(times, ["upload_id", "anchor_index"])
    return rows.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "upload_id", "chunk_index", "anchor_index", "timestamp")


def history(asked: DataFrame, k: int = 20) -> DataFrame:
    """Each user's last k different queries (whatever their case and outer white space), the newest first; asked: user, query, at."""
    latest = asked.groupBy("user", F.lower(F.trim("query")).alias("key")).agg(F.max_by("query", "at").alias("query"), F.max("at").alias("at"))
    return top(latest, ["user"], k, F.desc("at"), "key").select("user", "rank", "query", "at")
