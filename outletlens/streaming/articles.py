"""Streams: articles re-analysed as they come in, and windows over events (an addition of this engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def article_updates(stream: DataFrame, store: str, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Keep articles (event_id, article_id, text) under ``store`` and write ``analyse`` of every event that a batch touches to ``out``.

    A batch's rows and results go to folders named by its number, so a batch
    that runs again replaces its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.dropDuplicates(["event_id", "article_id"]).write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = rows.select("event_id").distinct()
        known = spark.read.parquet(store).drop("batch").dropDuplicates(["event_id", "article_id"])
        analyse(known.join(F.broadcast(touched) if touched.count() < 100_000 else touched, "event_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type in tumbling windows; rows later than ``late`` are dropped in a stream."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    made = seen.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: start, end and number of events."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    made = seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
