"""Messages written as exports of each platform and read back by its parser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import exports, fixtures


def _files(m: DataFrame, item: Column, whole, suffix: str) -> DataFrame:
    """A file for each conversation: an export is one file."""
    rows = m.groupBy("upload_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("msg_index", item.alias("x")))), lambda s: s["x"]).alias("all"))
    return rows.select(F.concat(F.lit("chat_"), "upload_id", F.lit(suffix)).alias("file"), whole(F.col("all")).alias("text"))


def _stamp() -> Column:
    return F.col("timestamp").cast("timestamp")


def garbled(x: Column) -> Column:
    """UTF-8 read as Latin-1, as some exports write it."""
    return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")


def as_whatsapp(m: DataFrame) -> DataFrame:
    return _files(m, F.concat(F.lit("["), F.date_format("timestamp", "dd/MM/yyyy, HH:mm:ss"), F.lit("] "), "sender", F.lit(": "), "content"), lambda a: F.array_join(a, "\n"), ".txt")


def as_telegram(m: DataFrame) -> DataFrame:
    target = F.regexp_extract("reply_to_id", r"(\d+)", 1).cast("bigint")
    item = F.struct(F.col("msg_index").alias("id"), F.lit("message").alias("type"), F.unix_seconds(_stamp()).cast("string").alias("date_unixtime"), F.col("sender").alias("from"), F.lit("u").alias("from_id"), F.array("content").alias("text"), target.alias("reply_to_message_id"))
    return _files(m, item, lambda a: F.to_json(F.struct(F.lit("x").alias("name"), F.lit("personal_chat").alias("type"), a.alias("messages"))), ".json")


def _as_meta(m: DataFrame, suffix: str, hint: str) -> DataFrame:
    item = F.struct(garbled(F.col("sender")).alias("sender_name"), F.unix_millis(_stamp()).alias("timestamp_ms"), garbled(F.col("content")).alias("content"))
    return _files(m, item, lambda a: F.to_json(F.struct(F.lit("x").alias(hint), F.reverse(a).alias("messages"))), suffix)


def as_instagram(m: DataFrame) -> DataFrame:
    return _as_meta(m, ".json", "thread_path")


def as_facebook(m: DataFrame) -> DataFrame:
    return _as_meta(m, ".json", "joinable_mode")


def as_csv(m: DataFrame) -> DataFrame:
    quoted = F.concat(F.lit('"'), F.replace("content", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", "sender", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), quoted)
    return _files(m, line, lambda a: F.concat(F.lit("author;date;text\n"), F.array_join(a, "\n")), ".csv")


WRITERS = {"whatsapp": as_whatsapp, "telegram": as_telegram, "instagram": as_instagram, "facebook": as_facebook, "csv": as_csv}


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.messages_from_events(spark, sf_dir).where("content <> ''")


def round_trip(platform: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = exports.PARSERS[platform](WRITERS[platform](said(spark, sf_dir)))
        return m.select(F.regexp_extract("file", r"_(\d+)\.", 1).cast("bigint").alias("upload_id"), "msg_index", "sender", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "content", "msg_type", "reply_to_id")

    return query


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The platform told for each of the files."""
    m = said(spark, sf_dir)
    return reduce(DataFrame.unionByName, [exports.detect(w(m)).withColumn("written_as", F.lit(k)) for k, w in WRITERS.items()]).select("file", "written_as", "platform")
