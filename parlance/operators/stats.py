"""Activity statistics of conversations. Every operator takes messages and answers for all conversations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T



def day() -> Column:
    return F.to_date("timestamp")


ORDER = ("timestamp", "msg_index")


def by_upload(*order) -> Window:
    return Window.partitionBy("upload_id").orderBy(*order)


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group; Spark cuts each task's rows to one a group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def gaps(m: DataFrame) -> DataFrame:
    """Minutes between messages of different senders that follow each other within a day."""
    w = by_upload(*ORDER)
    rows = m.select("upload_id", "sender", "timestamp", F.lag("sender").over(w).alias("before"), F.lag("timestamp").over(w).alias("since"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    minutes = (micros("timestamp") - micros("since")) / F.lit(60e6)
    return rows.where("before <> sender").withColumn("minutes", minutes).where(F.col("minutes") < 1440)


def overview_totals(m: DataFrame) -> DataFrame:
    per_day = F.col("total_messages") / F.col("active_days")
    rows = m.groupBy("upload_id").agg(
        F.count("*").alias("total_messages"), F.sum("word_count").alias("total_words"), F.sum("char_count").alias("total_chars"),
        F.sum(F.coalesce(F.size("emojis"), F.lit(0))).alias("total_emojis"), F.count_distinct(day()).alias("active_days"),
    )
    return rows.withColumn("messages_per_day", F.round(F.when(F.col("active_days") > 0, per_day).otherwise(0.0), 2))


def date_stats(m: DataFrame) -> DataFrame:
    """Days with messages, days from first to last, the longest run of days and the longest gap between two."""
    days = m.select("upload_id", day().alias("d")).distinct()
    w = by_upload("d")
    days = days.withColumns({"run": F.date_sub("d", F.row_number().over(w)), "gap": F.datediff("d", F.lag("d").over(w))})
    runs = days.groupBy("upload_id", "run").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("gap").alias("gap"))
    return runs.groupBy("upload_id").agg(
        F.sum("n").alias("active_days"), (F.datediff(F.max("hi"), F.min("lo")) + 1).cast("bigint").alias("conversation_days"),
        F.max("n").alias("longest_streak"), F.coalesce(F.max("gap"), F.lit(0)).cast("bigint").alias("longest_silence"),
    )


def _spine(m: DataFrame, spark_range: int, name: str) -> DataFrame:
    """Each conversation with all values of a small range."""
    return m.select("upload_id").distinct().withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(spark_range - 1))))


def hour_histogram(m: DataFrame) -> DataFrame:
    counts = m.groupBy("upload_id", F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    return _spine(m, 24, "hour").join(counts, ["upload_id", "hour"], "left").select("upload_id", "hour", F.coalesce("n", F.lit(0)).alias("messages"))


def busiest(m: DataFrame) -> DataFrame:
    """Hour, weekday (0 is Monday) and month with most messages; ties go to the smallest."""
    parts = {"hour": F.hour("timestamp").cast("string"), "weekday": F.weekday("timestamp").cast("string"), "month": F.date_format("timestamp", "yyyy-MM")}
    each = m.select("upload_id", F.explode(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)])).alias("part", "value"))
    counts = each.groupBy("upload_id", "part", "value").agg(F.count("*").alias("messages"))
    return first_of(counts, ["upload_id", "part"], F.desc("messages"), F.length("value"), "value")


def median_response(m: DataFrame) -> DataFrame:
    found = gaps(m).groupBy("upload_id").agg(F.round(F.percentile("minutes", F.lit(0.5)), 2).alias("median_minutes"))
    return m.select("upload_id").distinct().join(found, "upload_id", "left")


def who_texts_first(m: DataFrame) -> DataFrame:
    starts = first_of(m.select("upload_id", "sender", "timestamp", "msg_index", day().alias("d")), ["upload_id", "d"], *ORDER)
    counts = starts.groupBy("upload_id", "sender").agg(F.count("*").alias("days"))
    return counts.withColumn("share", F.round(F.col("days") / F.sum("days").over(Window.partitionBy("upload_id")), 4))


def participants(m: DataFrame) -> DataFrame:
    return m.groupBy("upload_id", "sender").agg(
        F.count("*").alias("messages"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), F.sum(F.size("emojis")).alias("emojis"),
        F.count_if(T.is_question(F.col("content"))).alias("questions"), F.count_if(T.is_exclamation(F.col("content"))).alias("exclamations"),
        F.round(F.sum("char_count") / F.count("*"), 2).alias("avg_length"),
    )


def longest_message(m: DataFrame) -> DataFrame:
    return first_of(m.where("NOT is_deleted"), ["upload_id"], F.desc("char_count"), "msg_index").select("upload_id", "msg_id", "sender", "char_count", F.substring("content", 1, 280).alias("preview"))


def most_replied_to(m: DataFrame) -> DataFrame:
    """The message with most replies; none where the target is missing."""
    counts = m.where("reply_to_id IS NOT NULL").groupBy("upload_id", F.col("reply_to_id").alias("msg_id")).agg(F.count("*").alias("replies"))
    best = first_of(counts, ["upload_id"], F.desc("replies"), "msg_id")
    return best.join(m.select("upload_id", "msg_id", "sender", F.substring("content", 1, 280).alias("preview")), ["upload_id", "msg_id"])


def first_message(m: DataFrame) -> DataFrame:
    return first_of(m, ["upload_id"], *ORDER).select("upload_id", "msg_id", "sender", "timestamp", F.substring("content", 1, 280).alias("preview"))


def favourite_tokens(m: DataFrame) -> DataFrame:
    """Most used word and emoji of each sender and (sender null) of all; ties go to the one met first."""
    live = m.where("NOT is_deleted")
    words = live.select("upload_id", "sender", "msg_index", F.lit("word").alias("kind"), F.posexplode(F.filter(T.tokens(F.col("content")), lambda w: ~w.isin(*T.STOPWORDS))).alias("pos", "token"))
    emoji = live.select("upload_id", "sender", "msg_index", F.lit("emoji").alias("kind"), F.posexplode("emojis").alias("pos", "token"))
    each = words.unionByName(emoji)
    counts = each.groupBy("upload_id", "sender", "kind", "token").agg(F.count("*").alias("n"), F.min(F.struct("msg_index", "pos")).alias("at"))
    whole = counts.groupBy("upload_id", "kind", "token").agg(F.sum("n").alias("n"), F.min("at").alias("at")).withColumn("sender", F.lit(None).cast("string"))
    return first_of(counts.unionByName(whole), ["upload_id", "sender", "kind"], F.desc("n"), "at").select("upload_id", "sender", "kind", "token", F.col("n").alias("uses"))


def _of(m: DataFrame, sender: str | None) -> DataFrame:
    return m if sender is None else m.where(F.col("sender") == sender)


def participant_dive(m: DataFrame, sender: str | None = None) -> DataFrame:
    """Each sender's (or one's) counts, sentiment and emotions, hours apart."""
    rows = _of(m, sender)
    label = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy("upload_id", "sender").agg(
        F.count("*").alias("messages"), F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment"),
        *[label("sentiment_label", x).alias(x) for x in ("positive", "neutral", "negative")],
        *[label("emotion_label", x).alias(x) for x in EMOTIONS],
        F.min_by("msg_id", F.struct(*ORDER)).alias("first_msg"), F.max_by("msg_id", F.struct(*ORDER)).alias("last_msg"),
    )


#: The emotions, in their order.
EMOTIONS = ("joy", "love", "sadness", "anger", "fear", "surprise", "disgust")


def participant_words(m: DataFrame, sender: str | None = None, k: int = 10) -> DataFrame:
    rows = _of(m, sender).where("NOT is_deleted")
    words = rows.select("upload_id", "sender", "msg_index", F.posexplode(F.filter(T.tokens(F.col("content")), lambda w: ~w.isin(*T.STOPWORDS))).alias("pos", "word"))
    counts = words.groupBy("upload_id", "sender", "word").agg(F.count("*").alias("uses"), F.min(F.struct("msg_index", "pos")).alias("at"))
    return top(counts, ["upload_id", "sender"], k, F.desc("uses"), "at").select("upload_id", "sender", "rank", "word", "uses")


def participant_hours(m: DataFrame, sender: str | None = None) -> DataFrame:
    """Messages of each sender (or of one) in every hour of the day."""
    counts = _of(m, sender).groupBy("upload_id", "sender", F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    spine = counts.select("upload_id", "sender").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(counts, ["upload_id", "sender", "hour"], "left").select("upload_id", "sender", "hour", F.coalesce("n", F.lit(0)).alias("messages"))


def import_stats(m: DataFrame) -> DataFrame:
    """What a document's header holds: sums, media, average length of messages with text, days between first and last."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = m.groupBy("upload_id").agg(
        F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), F.sum(F.size("emojis")).alias("emojis"), F.count_if("has_media").alias("media"),
        F.round(F.avg(F.when(F.col("char_count") > 0, F.col("char_count"))), 2).alias("avg_length"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
    )
    return rows.withColumn("span_days", F.floor((micros(F.col("hi")) - micros(F.col("lo"))) / F.lit(86400e6)).cast("bigint")).drop("lo", "hi")


def participant_order(m: DataFrame) -> DataFrame:
    """Senders in the order in which they first speak."""
    first = m.where("NOT (msg_type = 'system' AND lower(sender) = 'system')").groupBy("upload_id", "sender").agg(F.min(F.struct(*ORDER)).alias("at"))
    return first.withColumn("place", F.row_number().over(by_upload("at"))).select("upload_id", "place", "sender")
