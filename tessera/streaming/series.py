"""Streams of readings and images: event-time windows, sliding statistics, and
segmentation of images as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", key: str = "event_type", ts: str = "ts", v: str = "value") -> DataFrame:
    """Count, sum, mean and extent by key and window; rows later than that are dropped."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    rows = stamped.groupBy(frame.alias("w"), key).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "s", "mean", "low", "high")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of rows of a key that are less than a gap apart."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = stamped.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def segment_each_batch(pixels: DataFrame, segment: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that segments the images of each micro-batch and appends the label maps to path."""

    def run(batch: DataFrame, _: int) -> None:
        segment(batch).write.mode("append").parquet(path)

    return pixels.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
