"""The same measures over a stream of messages: late ones are waited for as long as a watermark says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def buckets(m: DataFrame, unit: str = "day", late: str = LATE) -> DataFrame:
    """Messages and average sentiment of each day or week (from Monday; the epoch began on a Thursday)."""
    w = F.window("timestamp", "7 days", "7 days", "4 days") if unit == "week" else F.window("timestamp", "1 day")
    rows = m.withWatermark("timestamp", late).groupBy("upload_id", w.alias("w")).agg(F.count("*").alias("messages"), F.avg("sentiment_score").alias("sentiment"))
    return rows.select("upload_id", F.to_date("w.start").alias("bucket"), "messages", "sentiment")


def sessions(m: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    rows = m.withWatermark("timestamp", late).groupBy("upload_id", F.session_window("timestamp", gap).alias("w")).agg(F.count("*").alias("messages"))
    return rows.select("upload_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "messages")


def once(m: DataFrame, late: str = LATE) -> DataFrame:
    """Each message once, however often it is sent within the watermark."""
    return m.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["upload_id", "msg_id"])


def response_gaps(m: DataFrame) -> DataFrame:
    """Minutes to an answer by another sender, across batches: the state is a conversation's last sender and time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sender, since = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["timestamp", "msg_index"])
        out = []
        for s, t in zip(rows["sender"], rows["timestamp"]):
            now = int(t.value // 1000)
            if sender is not None and s != sender and now - since < 86_400_000_000:
                out.append((key[0], s, t, (now - since) / 60e6))
            sender, since = s, now
        state.update((sender, since))
        yield pd.DataFrame(out, columns=["upload_id", "sender", "timestamp", "minutes"])

    return m.groupBy("upload_id").applyInPandasWithState(run, "upload_id long, sender string, timestamp timestamp, minutes double", "sender string, since long", "append", GroupStateTimeout.NoTimeout)


def report(spark, hear: Callable[[str, int, float], None]) -> StreamingQueryListener:
    """Tells hear of each batch of the session's streams: the query's name, the batch's number and rows a second. spark.streams.removeListener ends it."""

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            p = event.progress
            hear(p.name or str(p.id), p.batchId, p.processedRowsPerSecond or 0.0)

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    out = Progress()
    spark.streams.addListener(out)
    return out


def stage(source: DataFrame, fill, path: str, checkpoint: str):
    """A stage of enrichment over a stream: each batch is filled and appended once; the checkpoint says which are done."""

    def each(batch: DataFrame, number: int) -> None:
        fill(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
