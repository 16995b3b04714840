"""Lists of conversations: pages, names, previews and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.stats import top

# Percent done at the start of each stage.
FLOORS = {"pending": 5, "parsing": 25, "nlp_processing": 55, "embedding": 85, "done": 100, "failed": 100}
READY = ("nlp_processing", "embedding", "done")


def page(uploads: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, with the number of all."""
    total = uploads.agg(F.count("*").alias("total"))
    return uploads.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit).crossJoin(total)  # total is one row


def display_name(participants: Column, filename: Column) -> Column:
    n = F.coalesce(F.size(participants), F.lit(0))
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    first = F.array_join(F.slice(participants, 1, 2), ", ")
    return (
        F.when(n == 0, stem).when(n == 1, participants[0]).when(n == 2, F.concat(participants[0], F.lit(" & "), participants[1]))
        .when(n <= 4, F.array_join(participants, ", ")).otherwise(F.concat(first, F.lit(" +"), (n - 2).cast("string")))
    )


def previews(m: DataFrame, uploads: DataFrame, k: int = 3) -> DataFrame:
    """The last k messages of each of the uploads that can be shown, the oldest first."""
    rows = m.join(uploads.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
    text = F.coalesce(F.col("content_english"), F.col("content"))
    rows = rows.withColumn("text", text).where((F.col("text") != "") & ~F.col("msg_type").isin("deleted", "system"))
    last = top(rows, ["upload_id"], k, F.desc("msg_index"))
    place = F.row_number().over(Window.partitionBy("upload_id").orderBy("msg_index"))
    return last.withColumn("place", place).select("upload_id", "place", "msg_index", "sender", T.preview(F.col("text")).alias("preview"))


def progress(uploads: DataFrame) -> DataFrame:
    """Percent done, and whether statistics and search may be asked for."""
    pairs = [x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v))]
    return uploads.select("id", "status", F.create_map(*pairs)[F.col("status")].alias("percent"), F.col("status").isin(*READY).alias("stats_ready"), (F.col("status") == "done").alias("search_ready"))


def response_gauge(minutes: Column) -> Column:
    """Fill of a gauge: full for an answer at once, least for an hour or more."""
    m = F.greatest(F.lit(0.0), F.least(F.lit(60.0), minutes.cast("double")))
    return F.greatest(F.lit(0.05), 1 - F.log10(1 + m) / F.log10(F.lit(61.0)))
