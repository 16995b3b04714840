"""Sentiment and emotion over time, by label and by sender."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.stats import EMOTIONS, first_of, top


def bucket(unit: str):
    return F.to_date(F.date_trunc(unit, "timestamp"))


def dominant(m: DataFrame, unit: str) -> DataFrame:
    """The most frequent emotion of each bucket; ties go to the first by name."""
    counts = m.where("emotion_label IS NOT NULL").groupBy("upload_id", bucket(unit).alias("bucket"), "emotion_label").agg(F.count("*").alias("n"))
    return first_of(counts, ["upload_id", "bucket"], F.desc("n"), "emotion_label").select("upload_id", "bucket", F.col("emotion_label").alias("dominant"))


def timeline(m: DataFrame, unit: str) -> DataFrame:
    """Average sentiment, messages and dominant emotion of each bucket, and each sender's part: one pass over the messages.

    Messages are first summed up by bucket and sender; the bucket's own figures come from those sums.
    """
    by = m.groupBy("upload_id", bucket(unit).alias("bucket"), "sender").agg(F.sum("sentiment_score").alias("s"), F.count("sentiment_score").alias("scored"), F.count("*").alias("n"))
    w = Window.partitionBy("upload_id", "bucket")
    avg = lambda s, n: F.round(F.when(n > 0, s / n), 9)
    rows = by.select(
        "upload_id", "bucket", "sender", F.col("n").alias("sender_messages"), avg(F.col("s"), F.col("scored")).alias("sender_sentiment"),
        F.sum("n").over(w).alias("messages"), avg(F.sum("s").over(w), F.sum("scored").over(w)).alias("sentiment"),
    )
    return rows.join(dominant(m, unit), ["upload_id", "bucket"], "left")


def distribution(m: DataFrame, by_sender: bool = False) -> DataFrame:
    """Messages and share of each emotion, those without any too; labels that aren't known count nowhere."""
    keys = ["upload_id", "sender"] if by_sender else ["upload_id"]
    counts = m.where(F.col("emotion_label").isin(*EMOTIONS)).groupBy(*keys, "emotion_label").agg(F.count("*").alias("n"))
    spine = m.select(*keys).distinct().withColumn("emotion_label", F.explode(F.array(*map(F.lit, EMOTIONS))))
    rows = spine.join(counts, [*keys, "emotion_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 4))


def samples(m: DataFrame, by_sender: bool = False, k: int = 2) -> DataFrame:
    """The strongest messages of each emotion."""
    keys = ["upload_id", "sender", "emotion_label"] if by_sender else ["upload_id", "emotion_label"]
    rows = m.where("emotion_label IS NOT NULL AND NOT is_deleted AND content <> ''")
    return top(rows, keys, k, F.desc_nulls_last("emotion_score"), "timestamp", "msg_index").select(*keys, "rank", "msg_id", "emotion_score")


def peaks(m: DataFrame, k: int = 5, least: int = 5) -> DataFrame:
    """Weeks of highest and of lowest average sentiment among those with enough scored messages."""
    weeks = m.where("sentiment_score IS NOT NULL").groupBy("upload_id", bucket("week").alias("bucket")).agg(F.round(F.avg("sentiment_score"), 6).alias("sentiment"), F.count("*").alias("scored")).where(F.col("scored") >= least)
    weeks = weeks.join(dominant(m, "week"), ["upload_id", "bucket"], "left").withColumn("bucket_end", F.date_add("bucket", 6))
    high = top(weeks, ["upload_id"], k, F.desc("sentiment"), "bucket").withColumn("kind", F.lit("peak"))
    low = top(weeks, ["upload_id"], k, F.asc("sentiment"), "bucket").withColumn("kind", F.lit("valley"))
    return high.unionByName(low)


def peak_messages(m: DataFrame, k: int = 3) -> DataFrame:
    """The messages that stand for each peak and valley."""
    found = peaks(m).select("upload_id", "bucket", "kind")
    rows = m.where("NOT is_deleted AND content <> ''").withColumn("bucket", bucket("week")).join(found, ["upload_id", "bucket"])
    sign = F.when(F.col("kind") == "peak", -F.col("sentiment_score")).otherwise(F.col("sentiment_score"))
    return top(rows, ["upload_id", "bucket", "kind"], k, sign.asc_nulls_last(), "timestamp", "msg_index").select("upload_id", "bucket", "kind", "rank", "msg_id", "sentiment_score")


def calendar(m: DataFrame) -> DataFrame:
    """Every day from the first to the last."""
    days = m.groupBy("upload_id", bucket("day").alias("bucket")).agg(F.round(F.avg("sentiment_score"), 4).alias("sentiment"), F.count("*").alias("messages"))
    span = days.groupBy("upload_id").agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"))).alias("bucket"))
    rows = span.join(days, ["upload_id", "bucket"], "left").join(dominant(m, "day"), ["upload_id", "bucket"], "left")
    return rows.withColumn("messages", F.coalesce("messages", F.lit(0)))


def extreme_days(m: DataFrame, least: int = 3) -> DataFrame:
    """The happiest and the hardest day among those with enough messages; ties go to the earlier."""
    days = calendar(m).where(F.col("sentiment").isNotNull() & (F.col("messages") >= least))
    return days.groupBy("upload_id").agg(F.min_by("bucket", F.struct(-F.col("sentiment"), F.col("bucket"))).alias("happiest"), F.min_by("bucket", F.struct("sentiment", "bucket")).alias("hardest"))
