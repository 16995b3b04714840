"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document's expected copies are its source's target over its source's
size. Within a source the documents stand in order of size (then of a digest of their id), their expected copies are
summed up, one offset is added for the whole source, and a document is emitted once for each integer that the sum
crosses at it. In order of size, the words taken differ from the target by no more than about the largest document.

The sums need no source in one task, and the sources need no driver: documents are counted by source, size and salt, the counts (not the documents)
are summed up within a source, and a document's place is its bucket's start plus its place in the bucket. A salt
splits a size that many documents share.

Null texts have no words. Sources that are null form one source, the last. A source without words gets a target of 0
and no copies. Rows that repeat a doc_id count as documents of their own. Reruns give the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import materialise, running_sums, table

#: Documents of a bucket that one task ranks.
BUCKET = 50_000
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Sources (_s, _n: their words) with target: shares of all words by weight; what is over most times a source's size is shared out among the others by weight, until none is over.

    A source with less room for its weight fills up first. In that order all are full up to the first whose share of
    what is left fits; from there on all get the same for their weight.
    """
    ranked = running_sums(sizes, [F.asc_nulls_last("_s")], {"_place": F.lit(1)})
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights)).cast("int"))
    room = F.lit(most) * F.col("_n") / F.col("_weight")
    rows = ranked.withColumn("_weight", weight).withColumn("_room", room)
    rows = running_sums(rows, [F.col("_room"), F.col("_place")], {"_full": F.lit(most) * F.col("_n"), "_taken": F.col("_weight"), "_words": F.col("_n").cast("double")}, "_all")
    level = (F.col("_all_words") - F.col("_full")) / (F.col("_all_taken") - F.col("_taken"))
    rows = rows.withColumn("_level", level).withColumn("_fits", (F.col("_n") > 0) & (F.lit(most) * F.col("_n") >= F.col("_level") * F.col("_weight")))
    first = rows.where("_fits").agg(F.min(F.struct("_room", "_place", "_level")).alias("_first"))  # one row
    share = F.col("_first._level") * F.col("_weight")
    full = F.col("_first").isNull() | (F.struct("_room", "_place") < F.struct("_first._room", "_first._place"))
    target = F.when(F.col("_n") == 0, F.lit(0.0)).when(full, F.lit(most) * F.col("_n")).otherwise(F.least(F.lit(most) * F.col("_n"), share))
    return rows.join(F.broadcast(first)).select("_s", "_n", target.alias("target"))


def plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", key_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """Every document with size, source_size, target and copies; keep: further columns to carry (default: key_col only)."""
    rows = docs.select(
        docs[key_col].alias("_k"),
        docs[source_col].alias("_s"),
        F.coalesce(F.concat(F.lit("s"), docs[source_col]), F.lit("n")).alias("_sk"),  # no null, so that plain equality joins
        n_words(docs[text_col]).alias("_n"),
        F.md5(F.coalesce(docs[key_col].cast("string"), F.lit(""))).alias("_key"),
        *[docs[c].alias(f"_c_{c}") for c in keep or []],
    )
    counts = materialise(rows.groupBy("_s", "_sk", "_n").agg(F.count("*").alias("_docs")))
    sizes = counts.groupBy("_s").agg(F.sum(F.col("_n") * F.col("_docs")).alias("_n"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("_s", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    goal = targets(sizes, weights, most).select(
        F.coalesce(F.concat(F.lit("s"), "_s"), F.lit("n")).alias("_sk"), F.col("_n").alias("source_size"), F.round("target", 6).alias("target"),
        F.when(F.col("_n") > 0, F.col("target") / F.col("_n")).otherwise(0.0).alias("_rate"), offset.alias("_u"),
    )
    # sizes that more than BUCKET documents share; at most one for each BUCKET documents, so the table is small
    crowded = counts.where(F.col("_docs") > BUCKET).select("_sk", "_n", F.ceil(F.col("_docs") / BUCKET).cast("int").alias("_salts"))
    salted, buckets = rows.withColumn("_salt", F.lit(0)), counts.select("_sk", "_n", F.lit(0).alias("_salt"), F.col("_docs").alias("_b"))
    if not crowded.isEmpty():
        # salts follow the order of the keys
        salt = F.coalesce((F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * F.col("_salts") / F.lit(1 << 32)).cast("int"), F.lit(0))
        salted = rows.join(F.broadcast(crowded), ["_sk", "_n"], "left").withColumn("_salt", salt).drop("_salts")
        again = salted.join(F.broadcast(crowded.select("_sk", "_n")), ["_sk", "_n"], "left_semi").groupBy("_sk", "_n", "_salt").agg(F.count("*").alias("_b"))
        buckets = buckets.where(F.col("_b") <= BUCKET).unionByName(again)
    before = Window.partitionBy("_sk").orderBy("_n", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("_sk", "_n", "_salt", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_start")).join(goal, "_sk")
    placed = salted.join(buckets, ["_sk", "_n", "_salt"])
    # within a bucket equal ids tie: either order takes as many copies of them
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_sk", "_n", "_salt").orderBy("_key"))
    crossed = F.floor(F.col("_rate") * F.col("_place") + F.col("_u")) - F.floor(F.col("_rate") * (F.col("_place") - 1) + F.col("_u"))
    return placed.withColumn("_place", place).select(
        F.col("_k").alias(key_col), F.col("_n").alias("size"), "source_size", "target",
        F.least(crossed, F.lit(int(most))).cast("bigint").alias("copies"), *[F.col(f"_c_{c}").alias(c) for c in keep or []],
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of docs."""
    columns = docs.columns
    out = plan(docs, keep=columns, **options)
    named = out.toDF("_key", "_size", "_source_size", "_target", "_copies", *[f"_c_{i}" for i in range(len(columns))])
    each = named.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select(*[F.col(f"_c_{i}").alias(c) for i, c in enumerate(columns)])


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents."""
    out = plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same places in one window over each source; a source's share of what is left is found in order of its room for its weight.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights FROM w),
c AS (SELECT a.source, a.source_size, a.weight, a.k,
        (a.total - coalesce(sum(3.0 * b.source_size), 0)) AS left_over, a.weights - coalesce(sum(b.weight), 0) AS left_weight
      FROM o a LEFT JOIN o b ON b.k < a.k GROUP BY a.source, a.source_size, a.weight, a.k, a.total, a.weights),
-- up to the first source whose share fits, all before it are full; from there on all get the same for their weight
f AS (SELECT *, left_over / left_weight AS per_weight, 3.0 * source_size >= left_over / left_weight * weight AS fits FROM c),
g AS (SELECT *, (SELECT per_weight FROM f WHERE fits ORDER BY k LIMIT 1) AS level, (SELECT min(k) FROM f WHERE fits) AS k0 FROM f),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN k0 IS NULL OR k < k0 THEN 3.0 * source_size ELSE least(3.0 * source_size, level * weight) END::DOUBLE AS target,
        ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM g),
p AS (SELECT doc_id, size, t.source_size, t.target, u, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END::DOUBLE AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, ''))) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * least(floor(rate * place + u) - floor(rate * (place - 1) + u), 3))::BIGINT AS taken FROM p
"""
