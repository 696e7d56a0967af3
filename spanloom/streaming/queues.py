"""Streams: stateful dedupe, day counters with lateness, idempotent acknowledgement of a queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 day") -> DataFrame:
    """First arrival of every key within the lateness; state is dropped behind the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def day_counts(stream: DataFrame, time: str, lateness: str = "1 hour") -> DataFrame:
    """Rows per UTC day, a day closed once the watermark has passed it."""
    counted = stream.withWatermark(time, lateness).groupBy(F.window(time, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), "n")


def drain(stream: DataFrame, process: Callable[[DataFrame], DataFrame], acks: str, key: str, checkpoint: str) -> StreamingQuery:
    """Process a queue in micro-batches; only rows that `process` returns are acknowledged, each once.

    Delivery is at least once: a batch that is run again finds its acknowledged rows and adds none of them twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        from ..sources.writers import report

        report(process(df).select(key), acks, key)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
