"""Running event counts by day and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.scalars import col


def daily_counts(events: DataFrame, ts: str, kind: str, lateness: str = "1 hour", day: str = "1 day") -> DataFrame:
    """(day, type, n): a batch count, or with a stream a windowed count that drops late events.

    The state holds one row per open day and type.
    """
    if events.isStreaming:
        events = events.withWatermark(ts, lateness)
    counted = events.groupBy(F.window(col(ts), day).alias("w"), col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("date").alias("day"), "type", "n")


def activity_stream(events: DataFrame, ts: str, kind: str, path: str, checkpoint: str, lateness: str = "1 hour", once: bool = True):
    """Start the running count into Parquet under ``path``; ``checkpoint`` makes a restart exact.

    A day is written when the watermark passes its end. ``once`` works through what is there and stops.
    """
    writer = (
        daily_counts(events, ts, kind, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()
