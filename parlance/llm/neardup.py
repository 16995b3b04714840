"""Near-duplicate groups: SuperMinHash bands, verification on full shingle sets, connected components.

1. Each document gives its set's size and digest, its registers and the hashes of its bands (a map without a shuffle).
2. Documents of equal sets form a class, which the digest names; copies are not expanded.
3. Classes that share a band meet in its bucket. Every class is compared, on full sets, with the bucket's least one;
   the links found give components. Where a bucket's classes are still in several components, all pairs across them
   are compared: each large component of such a bucket is cut into blocks of its own, the small ones share blocks, and
   each pair of blocks that isn't all one component is one task's work. Registers that rule a similarity out, and pairs
   that meet in an earlier band too, are passed over; what is left is compared on full sets. So no pair that shares a
   band loses its link, however large the bucket, but for those whose registers agree too seldom.
4. Components of all links; the least doc_id names each.

With 24 bands of 4 registers a pair of similarity 0.8 shares no band with a probability of 3e-6, and its registers
agree in less than 0.62 with one of 5e-6, by the formula for independent registers.

Keys that many rows share (a large bucket, its leader, a large class) are met by broadcast or spread by a salt.

Null and empty texts and texts of white space have an empty set and are linked with nothing. Rows that repeat an id
are rows of their own: with equal texts they are returned alike, with different ones each has its own text's component.
Rows without an id take no part and are never kept. Ids may be of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import common, minhash
from parlance.llm.common import begin, discard, in_arrow, join_hot, materialise, slices, table
from parlance.llm.components import components

REGISTERS, BANDS = 96, 24
#: Least share of equal registers with which a pair is compared on full sets.
ESTIMATE = 0.62
#: Shingles (8 bytes each) and classes of a bucket that one block holds, more or less.
BLOCK, ROWS = 2_000_000, 4_096


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text), n_shingles, digest of the set, registers (a byte each) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", minhash.forget)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            n, digests, registers, bands = [], [], [], []
            for text in batch.column(2):
                s = minhash.shingle_set(text.as_py(), width)
                n.append(len(s))
                digests.append(minhash.digest(s))
                g = minhash.signature(s, REGISTERS)
                registers.append((g & np.uint64(0xFF)).astype(np.uint8).tobytes())
                bands.append(minhash.band_hashes(g, BANDS).view(np.int64) if len(s) else [])
            columns = [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_shingles", "digest", "registers", "bands"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("doc_id"), text_key(docs[text_col]).alias("key"), docs[text_col].alias("text"))
    return in_arrow(rows, run, f"doc_id {kind}, key bigint, n_shingles bigint, digest binary, registers binary, bands array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node and the shingle set of text as 64-bit integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("shingles", minhash.forget)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sets = [minhash.shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return in_arrow(docs.select("node", "text"), run, "node binary, shingles binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int(np.count_nonzero(y[at] == x))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return in_arrow(pairs.select("a", "b", "x", "y"), run, "a binary, b binary")


def _links_in_cell(band: int, same: bool, rows: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links across components among a cell's rows (node, component, block is the second, registers, shingles, bands), at most a forest's worth."""
    label = np.unique([r[1] for r in rows], return_inverse=True)[1]
    g = np.stack([np.frombuffer(r[3], np.uint8) for r in rows])
    size = np.array([len(r[4]) // 8 for r in rows])
    second = np.array([r[2] for r in rows])
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    # whole hashes, as buckets are made of them: the registers' bytes agree more often
    bands = np.stack([r[5] for r in rows])
    out = []
    for i in range(len(rows) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not same:
            rest = rest[second[rest] != second[i]]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        share = (g[rest] == g[i]).mean(axis=1)
        first = (bands[rest] == bands[i]).argmax(axis=1)
        for j in rest[(share >= ESTIMATE) & (first == band)]:
            if label[i] != label[j] and _similar(sets[i], sets[j], percent):
                out.append((rows[i][0], rows[j][0]))
                label[label == label[j]] = label[i]
    return out


def _verify_cells(cells: DataFrame, percent: int) -> DataFrame:
    """Rows sorted by cell: bucket, i, j, band, node, component, is_second, registers, shingles, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows):
            links = _links_in_cell(key[3], key[1] == key[2], rows, percent) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            bands = batch.column(9).flatten().to_numpy().reshape(-1, BANDS)
            for r in zip(*(c.to_pylist() for c in batch.columns[:9]), bands):
                if r[:4] != key:
                    if len(rows) > 1:
                        yield done(key, rows)
                    key, rows = r[:4], []
                rows.append(r[4:])
        if len(rows) > 1:
            yield done(key, rows)

    return in_arrow(cells.select("bucket", "i", "j", "band", "node", "component", "second", "registers", "shingles", "bands"), run, "a binary, b binary")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b: a bucket's leader) with the sets x and y; a leader of many pairs is spread over salts, its set going to each."""
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    leaders = pairs.groupBy("b").agg(F.count("*").alias("pairs"), F.ceil(F.count("*") / common.HOT).cast("int").alias("salts"))
    if leaders.where("salts > 1").isEmpty():
        return pairs.join(x, "a").join(y, "b")
    salted = join_hot(pairs, leaders, "b", "pairs", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    copies = y.join(leaders, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return salted.select("a", "b", "salt").join(x, "a").join(copies.select("b", "salt", "y"), ["b", "salt"])


def _MIXED() -> Column:
    return F.lit("").cast("binary")


def _cells(named: DataFrame) -> DataFrame:
    """bucket, i, j (blocks), band, node, component and second, for every pair of blocks of a bucket that can hold two components.

    named: bucket, band, node, n_shingles, component. A component of more than a block's rows has blocks of its own in a
    bucket; the others share the bucket's mixed blocks (home ""). Rows go to the pairs of their block with all blocks of
    another home, and with those of the mixed home if that is theirs.
    """
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    needed = lambda: F.greatest(F.ceil(F.sum("n") / ROWS), F.ceil(F.sum("shingles") / BLOCK)).cast("int")
    large = (F.col("n") > ROWS) | (F.col("shingles") > BLOCK)
    homes = counts.withColumn("home", F.when(large, F.col("component")).otherwise(_MIXED())).groupBy("bucket", "home").agg(needed().alias("blocks"))
    # a bucket's homes: one for each ROWS of its rows or BLOCK of its shingles at most, and the mixed one
    layout = homes.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("home", "blocks"))).alias("homes"))
    rows = named.join(layout, "bucket")
    home = lambda name: F.get(F.filter("homes", lambda h: h["home"] == name), F.lit(0))
    rows = rows.withColumn("own", F.coalesce(home(F.col("component")), home(_MIXED())))
    rows = rows.withColumn("block", F.struct(F.col("own.home").alias("home"), F.pmod(F.xxhash64("node"), F.col("own.blocks")).cast("int").alias("k")))
    every = F.flatten(F.transform("homes", lambda h: F.transform(F.sequence(F.lit(0), h["blocks"] - 1), lambda k: F.struct(h["home"].alias("home"), k.alias("k")))))
    met = F.filter(every, lambda b: (b["home"] != F.col("block.home")) | (F.col("block.home") == _MIXED()))
    rows = rows.withColumn("other", F.explode(met))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "node", "component", (F.col("block") > F.col("other")).alias("second"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key (of its text), n_shingles, component_id, kept."""
    sketch = materialise(sketches(docs, width, id_col, text_col))
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    # equal sets give equal registers and bands, so any row's will do; one row of each class stands for its text
    classes = materialise(full.groupBy(F.col("digest").alias("node")).agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("copies")))
    least = classes.select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.key").alias("key"))
    reps = full.withColumnRenamed("digest", "node").join(least, ["node", "doc_id", "key"]).dropDuplicates(["node"])
    entries = materialise(reps.select("node", "doc_id", "key", "n_shingles", F.posexplode("bands").alias("band", "bucket")))
    leads = materialise(entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1"))
    buckets = materialise(join_hot(entries, leads, "bucket", "members", entries.count()))
    members = buckets.select("node", F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    texts = docs.select(docs[id_col].alias("_id"), text_key(docs[text_col]).alias("_key"), docs[text_col].alias("text")).join(members, ["_id", "_key"])
    # a class's row may be repeated
    sets = materialise(_sets(texts, width).groupBy("node").agg(F.min("shingles").alias("shingles")).join(reps.select("node", "registers", "bands"), "node"))

    pairs = materialise(buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    links = materialise(_verify_pairs(_with_sets(pairs, sets), percent))
    first = materialise(components(links))

    named = buckets.select("bucket", "band", "node", "n_shingles").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    # a bucket of two has been compared already
    open_ = materialise(open_.where("lo <> hi AND members > 2").select("bucket", "members"))
    named = materialise(join_hot(named, open_, "bucket", "members", entries.count()).drop("members"))
    cells = _cells(named).join(sets, "node")
    cells = cells.withColumns({"i": F.to_json("i"), "j": F.to_json("j")}).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = _verify_cells(cells, percent)
    linked = materialise(components(more.union(first.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    for done in (entries, leads, buckets, sets, pairs, links, first, open_, named):
        discard(done)

    # a component's name is the least id of its classes
    joined = classes.select("node", F.col("least.doc_id").alias("doc_id"), "copies").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = materialise(joined.select("component", F.col("node").alias("digest"), "copies").join(names, "component").select("digest", "copies", "component_id"))
    out = join_hot(sketch.select("doc_id", "key", "n_shingles", "digest"), ids, "digest", "copies", sketch.count(), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents that share 80 % of their two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("key")


#: All pairs that share a shingle, and reachability over the links among them.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id))::BIGINT AS component_id, d.doc_id <= coalesce(m.m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) m ON m.x = d.doc_id
"""
