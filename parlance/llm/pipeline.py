"""The corpus pipeline: quality, language, near-duplicates, the mix of sources, and tokens.

Each stage takes the documents that the one before it kept, as a Parquet table, and returns documents with the same
columns; the last returns their tokens. Null and empty texts are scored as empty ones; a stage never drops a document
for a null in another column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import bpe, langid, mix, neardup, quality
from parlance.llm.common import discard, free_name, materialise

#: Texts go of whose n-grams a smaller share belongs to their best language: noise, and languages that none was learned of.
LEAST_SHARE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones among docs, scores as good."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=docs.columns, out=free_name("quality_score", docs.columns), least=quality.THRESHOLD).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages, the filters' share of their n-grams says."""
    out = free_name("lang_pred", docs.columns), free_name("lang_score", docs.columns)
    return langid.predict(docs, langid.learn(docs), keep=docs.columns, out=out, least_share=LEAST_SHARE).select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that shares 80 % of its five-word shingles.

    Decisions are for an id and its text: an id's different texts are documents of their own. Of rows that repeat both,
    the one whose other columns sort first stays. Rows without an id, and texts without words, stay.
    """
    found = neardup.near_duplicates(docs)
    gone = found.where("doc_id IS NOT NULL AND n_shingles > 0 AND NOT kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    key, place = free_name("_text_key", docs.columns), free_name("_row_place", docs.columns)
    kept = docs.withColumn(key, neardup.text_key(docs["text"]))
    kept = materialise(kept.join(gone, (kept["doc_id"] == gone["_id"]) & (kept[key] == gone["_key"]), "left_anti"))
    again = kept.where("doc_id IS NOT NULL").groupBy("doc_id", key).agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return kept.drop(key)
    in_order = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn(place, in_order).where(F.col("doc_id").isNull() | (F.col(place) == 1)).drop(key, place)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    return mix.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and digests of the ids and of what they decode to."""
    return bpe.encode(docs, bpe.default_path(), keep=["doc_id", "source"], ids=True, digests=True)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", neardup_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]
#: The classifiers and the merges have no SQL; tests hold each stage against a plain form of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents that all stages keep. A stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
