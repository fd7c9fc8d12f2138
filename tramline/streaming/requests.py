"""Streams of trip requests and of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer_requests(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answers each micro-batch of requests by one batch search and keeps the answers by batch, so a batch that is run
    again replaces its own answers."""

    def run(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events and their value by type in windows of an hour; works on a stream (with a watermark) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")
