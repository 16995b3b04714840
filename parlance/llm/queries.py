"""The queries of this subpackage by name, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import ann, bpe, fingerprint, langid, mix, neardup, pagetext, pipeline, quality, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_warc": warc.op3_warc,
    "op4_nearest": ann.op4_nearest,
    "op5_quality": quality.op5_quality,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_language": langid.op7_language,
    "op8_page_text": pagetext.op8_page_text,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_mix": mix.op10_mix,
    "pipeline": pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.OP3_SQL,
    "op6_near_duplicates": neardup.OP6_SQL,
    "op10_mix": mix.OP10_SQL,
}
