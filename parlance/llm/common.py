"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. A local default only in local mode.

    It is deleted when the application's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = f"file://{os.path.abspath('spark-warehouse')}/shared"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, so that nothing before it runs again and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise wrote, once nothing reads it any more."""
    fs, at = _file_system(df.sparkSession, df._materialised.rsplit("/", 1)[0])
    fs.delete(at, True)


#: Bytes of an Arrow batch between the JVM and a worker. By rows alone, batches of long texts or large sets have no bound.
BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow over batches of at most about BATCH bytes, or fewer where the session says so."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_BYTES, None) or 1 << 40) > BATCH:
        conf.set(_BATCH_BYTES, str(BATCH))
    return df.mapInArrow(fn, schema)


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the text of no character."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound rows, those of the least hashes of key: the same rows whatever the partitions are. All rows if there are no more."""
    n = rows.count()
    if n <= bound:
        return rows
    slot = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 53))  # exact in a double
    near = rows.where(slot < int(min(1.0, 1.2 * bound / n) * (1 << 53)))
    return near.orderBy(slot, *near.columns).limit(bound)


def free_name(name: str, taken: list[str]) -> str:
    """The name, lengthened until it is none of those taken."""
    while name in taken:
        name += "_"
    return name


#: Bytes of text that a worker turns to Python strings at once.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch's rows in parts of at most so many bytes in the column at that place, or of one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


class TwoGenerations(dict):
    """A bounded memo: when full, the younger half's entries become the older ones and those are dropped."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


_models: dict = {}
_memos: dict[str, Callable[[], None]] = {}


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """An operator's tasks start in this worker: the memos of the others go, as workers serve many stages. forget empties its own."""
    others = [n for n in _memos if n != operator]
    for name in others:
        _memos.pop(name)()
        for key in [k for k in _models if k[0] == name]:
            _models.pop(key)
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        _trim()
    # memos are large and hold no cycles: looking for such among them takes long
    gc.set_threshold(100_000, 20, 20)
    _memos[operator] = forget or (lambda: None)


def shared_model(spark: SparkSession, value) -> tuple:
    """A broadcast of a model of a fixed size, and a name for it."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(value)


def worker_model(operator: str, shared: tuple, make: Callable):
    """make(value) of a shared model, once in each worker; older ones of the operator go when there are several."""
    name, held = shared
    key = operator, name
    if key not in _models:
        own = [k for k in _models if k[0] == operator]
        for k in own[:-1]:
            _models.pop(k)
        _models[key] = make(held.value)
    return _models[key]


def scored(operator: str, docs: DataFrame, model, make: Callable, text_col: str, keep: list[str], out: dict[str, str], columns: Callable, choose: Callable | None = None, forget: Callable[[], None] | None = None) -> DataFrame:
    """keep's columns and those that make(model)(texts) gives, turned to Arrow by columns; choose tells the rows that stay.

    Each column crosses to Python once, the texts too where they are kept. Texts are scored in slices of about a megabyte.
    """
    shared = shared_model(docs.sparkSession, model)
    kinds = dict(docs.dtypes)
    sent = keep if text_col in keep else [*keep, text_col]
    at = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator, forget)
        score = worker_model(operator, shared, make)
        for whole in batches:
            for batch in slices(whole, at):
                got = score([t.as_py() for t in batch.column(at)])
                rows = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns(got)], names=[*keep, *out])
                yield rows if choose is None else rows.filter(pa.array(choose(got), pa.bool_()))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {k}" for c, k in out.items())])
    return in_arrow(docs.select(*[docs[f"`{c}`"] for c in sent]), run, schema)


#: Rows of one key beyond which it counts as hot, at least.
HOT = 1_000


def join_hot(rows: DataFrame, keys: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keys (a row for each key; n: its rows, total: those of all), inner or left; keys that many rows share meet theirs without a shuffle.

    At most 100,000 keys are broadcast, whatever the data: a key counts as hot from a hundred-thousandth of all rows on.
    """
    limit = max(HOT, total // 100_000)
    columns = [c for c in keys.columns if c != key]
    hot = keys.where(F.col(n) > limit).withColumn("_hot", F.lit(True))
    if hot.isEmpty():
        return rows.join(keys, key, how)
    first = rows.join(F.broadcast(hot), key, "left")
    warm = first.where("_hot").drop("_hot")
    cold = first.where("_hot IS NULL").drop("_hot", *columns).join(keys.where(F.col(n) <= limit), key, how)
    return warm.unionByName(cold)


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], total: str | None = None) -> DataFrame:
    """rows with sums over all rows before each in an order that has no ties, and (total: a prefix) over all rows.

    Rows are dealt into ranges of the order; the ranges' sums, one row each, are added up first, so no task gets all rows.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    # a row for each shuffle partition
    whole = Window.orderBy("_range")
    parts = parts.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{k}").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_before_{k}") for k in sums],
        *[F.sum(f"_sum_{k}").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{total}{k}") for k in sums if total is not None],
    )
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(parts), "_range")
    return out.withColumns({k: F.col(f"_before_{k}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()}).drop("_range", *[f"_before_{k}" for k in sums])
