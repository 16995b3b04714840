"""The pipeline's stages against plain forms of them, and the queries' contracts, on the smallest tables."""

import random
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from parlance.llm import bpe, langid, neardup, pipeline, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("quality_score", F.lit("clash"))
    good = pipeline.quality_stage(spark, docs, SF).cache()
    assert good.columns == docs.columns
    m = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r, s in zip(rows, m.score([r["text"] for r in rows])) if s >= 0.7}
    told = pipeline.language_stage(spark, good, SF).cache()
    one = langid.Scorer(langid.learn(good))
    assert {r["doc_id"] for r in told.collect()} == {r["doc_id"] for r in good.collect() if one(r["text"])[2] >= pipeline.LEAST_SHARE}
    kept = pipeline.neardup_stage(spark, told.union(told.limit(3)), SF).cache()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in neardup.near_duplicates(told).where("kept").collect())
    mixed = pipeline.mix_stage(spark, kept, SF).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = pipeline.bpe_stage(spark, mixed, SF)
    own = bpe.load(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out.count() == mixed.count() and all(r["ids"] == own.encode(texts[r["doc_id"]]) for r in out.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_rows_without_ids_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "en", None, None), (1, "a b c d e f", "en", None, None), (2, "a b c d e f", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in pipeline.neardup_stage(spark, docs, SF).collect()) == ["1", "None"]


def test_texts_of_a_repeated_id_are_documents_of_their_own(spark):
    rows = [(1, "a b c d e f", "en", "x", None), (1, "u v w x y z", "en", "x", None), (1, "u v w x y z", "en", "w", None), (2, "a b c d e f", "en", "x", None), (3, "", None, None, None), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _text_key long")
    kept = pipeline.neardup_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "", r["source"] or "") for r in kept.collect()) == [(1, "a b c d e f", "x"), (1, "u v w x y z", "w"), (3, "", ""), (4, "", "")]


def test_noise_is_in_no_language(spark):
    rng = random.Random(1)
    part = {"en": "the and ing ou th".split(), "fr": "le eau oi que ez".split()}
    rows = [(i, " ".join("".join(rng.choice(part[x]) for _ in range(3)) for _ in range(30)), x) for i in range(60) for x in [["en", "fr"][i % 2]]]
    rows += [(100, " ".join("".join(rng.choice("jkqvwxz") for _ in range(7)) for _ in range(30)), None), (101, "12 34", None), (102, None, "en")]
    got = pipeline.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_entry_without_the_subpackage(monkeypatch):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("parlance.llm", "corpus_pipeline") else real(n, *a))
    assert not [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"] and "A08_participants" in __spark_entry__.queries()
    assert "parlance" in sys.modules


@pytest.mark.parametrize("name,columns", [("op2_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op5_quality", {"doc_id", "held_out", "score", "predicted"}), ("op7_language", {"doc_id", "held_out", "lang_pred", "score"})])
def test_scores_cover_all_rows(spark, name, columns):
    df = __spark_entry__.queries()[name](spark, SF)
    assert columns <= set(df.columns)
    got = df.collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in got)
