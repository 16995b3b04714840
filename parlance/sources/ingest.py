"""Messages as tables: writing, enriching by new columns, exporting documents, stages and their barrier."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_messages(m: DataFrame, path: str) -> None:
    """A folder for each conversation, in order within it, so that a query of one reads only its files."""
    m.repartition("upload_id").sortWithinPartitions("upload_id", "msg_index").write.mode("append").partitionBy("upload_id").parquet(path)


def overwrite_columns(m: DataFrame, columns: dict, path: str) -> None:
    """The same rows with columns replaced, for the conversations at hand: there is no update in place."""
    m.withColumns(columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path)


def pending(m: DataFrame, column: str) -> DataFrame:
    """Rows that a stage hasn't filled yet: running it again goes on where it stopped."""
    return m.where(F.col(column).isNull())


def next_page(m: DataFrame, after: int, limit: int, column: str = "sentiment_label") -> DataFrame:
    """Of each conversation, the next rows after a place that a stage hasn't filled yet, in order: a page of at most limit rows."""
    w = Window.partitionBy("upload_id").orderBy("msg_index")
    rows = pending(m, column).where(F.col("msg_index") > after)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= limit).drop("_place")


def stamp_english(m: DataFrame) -> DataFrame:
    return m.withColumn("content_english", F.coalesce("content_english", "content"))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys aren't stored yet."""
    spark = rows.sparkSession
    try:
        stored = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    (rows if stored is None else rows.join(stored, keys, "left_anti")).write.mode("append").parquet(path)


def document(m: DataFrame, limit: int | None = None) -> DataFrame:
    """A JSON text for each conversation: its header and its first messages in order (all, if limit is null; none for 0 and below).

    One row holds a conversation, as a document must; a conversation is bounded by the size of its export.
    """
    meta = F.struct("msg_index", F.struct(F.col("msg_id").alias("id"), "sender", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "content", F.col("msg_type").alias("type"), "reply_to_id", F.struct("word_count", "char_count", "has_emoji", "emojis", "has_url", "is_deleted", "has_media").alias("metadata")).alias("message"))
    kept = F.lit(True) if limit is None else F.col("msg_index") < max(0, limit)
    rows = m.groupBy("upload_id").agg(F.count("*").alias("total"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.array_sort(F.collect_set("sender")).alias("senders"), F.array_sort(F.collect_list(F.when(kept, meta))).alias("all"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    head = F.struct(F.col("senders").alias("participants"), F.col("total").alias("total_messages"), F.struct(day("lo").alias("start"), day("hi").alias("end")).alias("date_range"))
    return rows.select("upload_id", F.to_json(F.struct(F.lit("1.0").alias("ucj_version"), head.alias("meta"), F.transform("all", lambda x: x["message"]).alias("messages"))).alias("document"))


def write_documents(m: DataFrame, path: str) -> None:
    document(m).select("document").write.mode("overwrite").text(path)


class Results:
    """Result tables by name, with the time at which each expires."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, name: str, df: DataFrame, seconds: int) -> None:
        df.withColumn("_expires", F.current_timestamp() + F.make_dt_interval(secs=F.lit(float(seconds)))).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def get(self, name: str) -> DataFrame | None:
        """The table's rows; null if it was never put or has expired."""
        try:
            df = self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        live = df.where(F.col("_expires") > F.current_timestamp())
        return None if live.isEmpty() else live.drop("_expires")


def latest_status(events: DataFrame) -> DataFrame:
    """Each upload's last status of an append-only table of them."""
    return events.groupBy("upload_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def together(*stages) -> list:
    """Runs stages that don't wait for each other at once, and returns when all are done; the first error is raised."""
    with ThreadPoolExecutor(max(1, len(stages))) as pool:
        return [f.result() for f in [pool.submit(s) for s in stages]]
