"""Word, pair and emoji statistics. A conversation's tokens are counted by sender first; all else is made from those counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.names import emoji_name
from parlance.operators.stats import day, top


def live(m: DataFrame) -> DataFrame:
    return m.where("NOT is_deleted")


def token_counts(m: DataFrame) -> DataFrame:
    """upload_id, sender, word, n, at (where it comes first) and is_stop, without links."""
    each = live(m).select("upload_id", "sender", "msg_index", F.posexplode(T.tokens_without_links(F.col("content"))).alias("pos", "word"))
    rows = each.groupBy("upload_id", "sender", "word").agg(F.count("*").alias("n"), F.min(F.struct("msg_index", "pos")).alias("at"))
    return rows.withColumn("is_stop", F.col("word").isin(*T.CONTENT_STOPWORDS))


def corpus_scan(m: DataFrame) -> DataFrame:
    c = token_counts(m)
    return c.groupBy("upload_id", "sender").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_words"), F.count_if(~F.col("is_stop")).alias("distinct_content_words"))


def frequency(m: DataFrame, k: int = 100, sender: str | None = None, exclude_stopwords: bool = True) -> DataFrame:
    """The k most used words with their share of all tokens and each sender's uses."""
    c = token_counts(m)
    if sender is not None:
        c = c.where(F.col("sender") == sender)
    words = c.groupBy("upload_id", "word", "is_stop").agg(F.sum("n").alias("uses"), F.min("at").alias("at"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sender", "n")))).alias("per_sender"))
    words = words.withColumn("share", F.round(F.col("uses") / F.sum("uses").over(Window.partitionBy("upload_id")), 6))
    if exclude_stopwords:
        words = words.where("NOT is_stop")
    return top(words, ["upload_id"], k, F.desc("uses"), "at").select("upload_id", "rank", "word", "uses", "share", "per_sender")


def bigram_counts(m: DataFrame) -> DataFrame:
    """Adjacent pairs without a stopword."""
    each = live(m).select("upload_id", "sender", "msg_index", F.posexplode(T.bigrams(T.tokens_without_links(F.col("content")))).alias("pos", "pair"))
    stop = lambda c: F.col(c).isin(*T.CONTENT_STOPWORDS)
    each = each.where(~stop("pair.first") & ~stop("pair.second")).withColumn("bigram", F.concat_ws(" ", "pair.first", "pair.second"))
    return each.groupBy("upload_id", "sender", "bigram").agg(F.count("*").alias("n"), F.min(F.struct("msg_index", "pos")).alias("at"))


def bigrams(m: DataFrame, k: int = 20) -> DataFrame:
    c = bigram_counts(m).groupBy("upload_id", "bigram").agg(F.sum("n").alias("uses"), F.min("at").alias("at"))
    return top(c, ["upload_id"], k, F.desc("uses"), "at").select("upload_id", "rank", "bigram", "uses")


def inside_phrases(m: DataFrame, least: int = 3, k: int = 16) -> DataFrame:
    """Pairs that every sender (of two at least) uses often: senders who do, counted against senders there are."""
    c = bigram_counts(m)
    senders = c.groupBy("upload_id").agg(F.count_distinct("sender").alias("senders")).where("senders >= 2")
    found = c.groupBy("upload_id", "bigram").agg(F.count_if(F.col("n") >= least).alias("by"), F.sum("n").alias("uses"), F.min("at").alias("at"))
    return top(found.join(senders, "upload_id").where("by = senders"), ["upload_id"], k, F.desc("uses"), "at").select("upload_id", "rank", "bigram", "uses")


def richness(m: DataFrame) -> DataFrame:
    return corpus_scan(m).select("upload_id", "sender", F.col("distinct_content_words").alias("unique_words"), "tokens", F.round(F.col("distinct_content_words") / F.col("tokens"), 4).alias("richness"))


def distinctive(m: DataFrame, least: int = 5, k: int = 12) -> DataFrame:
    """Words that a sender uses for a large part of all uses."""
    c = token_counts(m).where("NOT is_stop")
    total = F.sum("n").over(Window.partitionBy("upload_id", "word"))
    rows = c.withColumn("total", total).where(F.col("total") >= least).withColumn("score", F.col("n") / F.col("total"))
    out = top(rows, ["upload_id", "sender"], k, F.desc("score"), F.desc("n"), "word")
    return out.select("upload_id", "sender", "rank", "word", F.col("n").alias("uses"), "total", F.round("score", 6).alias("score"))


def length_timeline(m: DataFrame) -> DataFrame:
    return live(m).where("content <> ''").groupBy("upload_id", day().alias("day"), "sender").agg(F.round(F.avg("char_count"), 2).alias("avg_length"))


def emoji_frequency(m: DataFrame) -> DataFrame:
    """Uses, share and average sentiment (over occurrences) of each emoji."""
    each = live(m).select("upload_id", "sender", "sentiment_score", F.explode("emojis").alias("emoji"))
    rows = each.groupBy("upload_id", "emoji").agg(F.count("*").alias("uses"), F.round(F.avg("sentiment_score"), 4).alias("avg_sentiment"))
    rows = rows.withColumn("share", F.round(F.col("uses") / F.sum("uses").over(Window.partitionBy("upload_id")), 6))
    # names are looked up for the counted rows, not for each use
    return rows.withColumn("unicode_name", emoji_name(F.col("emoji")))


def emoji_by_sender(m: DataFrame) -> DataFrame:
    """Each sender's uses of each emoji."""
    return live(m).select("upload_id", "sender", F.explode("emojis").alias("emoji")).groupBy("upload_id", "emoji", "sender").agg(F.count("*").alias("uses"))


def emoji_of_one_sender(m: DataFrame, least: int = 5, share: float = 0.7, k: int = 12) -> DataFrame:
    """Emoji of which one sender has most uses."""
    c = live(m).select("upload_id", "sender", F.explode("emojis").alias("emoji")).groupBy("upload_id", "emoji", "sender").agg(F.count("*").alias("n"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy("upload_id", "emoji"))).withColumn("share", F.round(F.col("n") / F.col("total"), 6))
    return top(c.where((F.col("total") >= least) & (F.col("share") >= share)), ["upload_id", "sender"], k, F.desc("n"), "emoji").select("upload_id", "sender", "rank", "emoji", "n", "share")


def trend(m: DataFrame, word: str) -> DataFrame:
    """Messages with the word on each day."""
    return live(m).where(T.contains_word(F.col("content"), word)).groupBy("upload_id", day().alias("day")).agg(F.count("*").alias("messages"))


NIGHT = (23, 0, 1, 2, 3, 4)


def late_night(m: DataFrame) -> DataFrame:
    """Messages at night of each sender and hour, with their share of all messages."""
    hour = F.hour("timestamp")
    rows = m.groupBy("upload_id", "sender", hour.alias("hour")).agg(F.count("*").alias("messages"))
    rows = rows.withColumn("all_messages", F.sum("messages").over(Window.partitionBy("upload_id")))
    rows = rows.where(F.col("hour").isin(*NIGHT)).withColumn("at_night", F.sum("messages").over(Window.partitionBy("upload_id")))
    return rows.withColumn("night_share", F.round(F.col("at_night") / F.col("all_messages"), 6)).drop("all_messages")


def late_night_samples(m: DataFrame, k: int = 6) -> DataFrame:
    rows = live(m).where(F.hour("timestamp").isin(*NIGHT) & (F.col("content") != ""))
    return top(rows, ["upload_id"], k, F.desc(F.abs(F.coalesce("sentiment_score", F.lit(0.0)))), F.desc("timestamp"), "msg_index").select("upload_id", "rank", "msg_id", "sentiment_score")


def wide(df: DataFrame, keys: list[str], value: str, senders: list[str] | None = None) -> DataFrame:
    """Long rows by sender as a column for each sender: those named, or all that there are (for tables of a few conversations)."""
    return df.groupBy(*keys).pivot("sender", senders).agg(F.first(value))


def dominant_sender(m: DataFrame, k: int = 20) -> DataFrame:
    """Of the most used words, the sender who uses each most."""
    c = token_counts(m).where("NOT is_stop")
    words = c.groupBy("upload_id", "word").agg(F.sum("n").alias("uses"), F.min("at").alias("at"), F.min_by("sender", F.struct(-F.col("n"), F.col("sender"))).alias("sender"))
    return top(words, ["upload_id"], k, F.desc("uses"), "at").select("upload_id", "rank", "word", "uses", "sender")
