"""A bounded sample of labelled texts for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bounded_sample, crc_mod

#: Labelled rows that a model is fitted on, and characters of all of them together, at most.
SAMPLE, CHARACTERS = 6_000, 40_000_000


def sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, held_out: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", characters: int = CHARACTERS) -> list[tuple[str, int]]:
    """(text, label) of at most sample rows and as many characters, in the order of a hash of their ids; texts of any length.

    Held-out ids (crc32 of the id as text, modulo mod) are never among them. An id labelled twice counts once, as 1 if
    at least half of its labels are; rows without an id, label or text, and labels without a document, are left out.
    Ids are compared as text. Rows that repeat an id are one for each text.
    """
    ids = lambda df: df[id_col].cast("string").alias("_id")
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(ids(labels)).agg((F.avg(labels[label_col]) >= 0.5).cast("int").alias("_y"))
    known = bounded_sample(known.where(crc_mod(F.col("_id"), mod) != held_out), "_id", sample)
    pairs = [(r["_id"], r["_y"]) for r in known.collect()]
    if not pairs:
        return []
    spark = docs.sparkSession
    texts = docs.select(ids(docs), docs[text_col].alias("_text")).where("_text IS NOT NULL")
    order, place = F.xxhash64(F.col("_id"), F.lit("order")), F.xxhash64("_text")
    # which texts, by their lengths: a few bytes for each of at most sample ids; repeated ids add theirs up to twice as many
    sizes = texts.join(F.broadcast(spark.createDataFrame(pairs, "_id string, _y int")), "_id").select("_id", "_y", order.alias("_o"), place.alias("_p"), F.length("_text").alias("_n"))
    chosen, left = [], characters
    for r in sizes.distinct().orderBy("_o", "_id", "_p").limit(2 * sample).collect():
        if r["_n"] <= left and len(chosen) < sample:
            chosen.append((r["_id"], r["_p"], r["_y"]))
            left -= r["_n"]
    if not chosen:
        return []
    wanted = F.broadcast(spark.createDataFrame(chosen, "_id string, _p bigint, _y int"))
    rows = texts.withColumn("_p", place).join(wanted, ["_id", "_p"]).groupBy("_id", "_p").agg(F.first("_text").alias("_text"), F.first("_y").alias("_y"), F.first(order).alias("_o")).collect()
    return [(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_o"], r["_id"], r["_text"]))]
