"""Windows of a conversation for search: sessions cut into overlapping chunks, and what joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.stats import by_upload

SIZE, OVERLAP, GAP_MINUTES = 15, 2, 30


def text_of(m: DataFrame) -> Column:
    return F.trim(F.coalesce(F.when(F.col("content_english") != "", F.col("content_english")), F.col("content")))


def chunk_members(m: DataFrame) -> DataFrame:
    """Messages of each chunk: upload_id, chunk_index, pos and the message. A session ends at a gap of over 30 minutes.

    Within a session of n messages chunk k holds places 13 k to 13 k + 14; so a message is in one or two chunks, found
    by arithmetic on its place instead of by walking along the session.
    """
    step = SIZE - OVERLAP
    rows = m.withColumn("text", text_of(m)).where("msg_type = 'text' AND NOT is_deleted AND length(text) >= 2")
    w = by_upload("msg_index")
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = rows.withColumn("gap", (micros - F.lag(micros).over(w)) > GAP_MINUTES * 60_000_000)
    rows = rows.withColumn("session", F.sum(F.coalesce(F.col("gap"), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy("upload_id", "session")
    rows = rows.withColumns({"pos": F.row_number().over(s.orderBy("msg_index")) - 1, "n": F.count("*").over(s)})
    last = F.when(F.col("n") <= SIZE, 0).otherwise(F.ceil((F.col("n") - SIZE) / step)).cast("int")
    k = F.floor(F.col("pos") / step).cast("int")
    options = F.filter(F.array(k, F.when(F.col("pos") % step < OVERLAP, k - 1)), lambda x: (x >= 0) & (x <= last))
    rows = rows.withColumn("k", F.explode(options))
    index = F.dense_rank().over(by_upload("session", "k")) - 1
    return rows.withColumn("chunk_index", index)


def chunks(m: DataFrame) -> DataFrame:
    rows = chunk_members(m)
    line = F.struct("msg_index", F.concat("sender", F.lit(": "), "text").alias("line"))
    return rows.groupBy("upload_id", "chunk_index").agg(
        F.min("msg_index").alias("start_msg_index"), F.max("msg_index").alias("end_msg_index"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"),
        F.array_join(F.array_sort(F.collect_set("sender")), ",").alias("participants"), F.count("*").alias("messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("content"),
    )


def exploded(c: DataFrame) -> DataFrame:
    """A row for each message place of a chunk, so that a range join is one of equality."""
    return c.withColumn("msg_index", F.explode(F.sequence("start_msg_index", "end_msg_index")))


def chunk_messages(c: DataFrame, m: DataFrame) -> DataFrame:
    return exploded(c).join(m, ["upload_id", "msg_index"])


def message_chunk(c: DataFrame, m: DataFrame) -> DataFrame:
    """The first chunk that holds each message."""
    return chunk_messages(c, m).groupBy("upload_id", "msg_index").agg(F.min("chunk_index").alias("chunk_index"))


def missing(c: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks that are not stored yet."""
    return c.join(existing.select("upload_id", "chunk_index"), ["upload_id", "chunk_index"], "left_anti")


def anchors(members: DataFrame) -> DataFrame:
    """Of each chunk, the message nearest to the middle (the later of two) with four characters at least; else the middle one."""
    w = Window.partitionBy("upload_id", "chunk_index")
    rows = members.withColumns({"place": F.row_number().over(w.orderBy("msg_index")) - 1, "mid": F.floor(F.count("*").over(w) / 2)})
    far = F.struct((F.length("text") < 4).alias("short"), F.abs(F.col("place") - F.col("mid")).alias("d"), (F.col("place") < F.col("mid")).alias("before"))
    # if none is long enough, the middle one is the nearest of the short ones
    return rows.groupBy("upload_id", "chunk_index").agg(F.min_by("msg_index", far).alias("anchor_index"), F.count("*").alias("messages"))


def context(m: DataFrame, at: DataFrame, n: int = 10) -> DataFrame:
    """The n messages before and after each of at's (upload_id, msg_index), with their distance in messages."""
    w = by_upload("msg_index")
    rows = m.withColumn("rn", F.row_number().over(w))
    hits = rows.select("upload_id", "msg_index", "rn").join(at, ["upload_id", "msg_index"]).select("upload_id", F.col("msg_index").alias("around"), F.explode(F.sequence(F.col("rn") - n, F.col("rn") + n)).alias("rn"), F.col("rn").alias("centre"))
    return hits.join(rows, ["upload_id", "rn"]).select("upload_id", "around", "msg_index", (F.col("rn") - F.col("centre")).cast("int").alias("distance"))
