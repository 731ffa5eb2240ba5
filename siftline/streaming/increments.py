"""Structured Streaming: finite folders as a stream of files, and (beyond what the analyses need)
event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def emit_new_files(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform=lambda df: df) -> StreamingQuery:
    """Takes what is new in a folder of JSON lines since the last call, transforms and appends it."""
    rows = transform(spark.readStream.schema(schema).json(folder))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` behind the newest are dropped by the watermark."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def run_once(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, transform) -> None:
    """Takes the Parquet files that have come to a folder since the last call through ``transform`` (which may hold
    state and a watermark) and appends what is final to ``out``. State and place are kept in ``checkpoint``."""
    rows = transform(spark.readStream.schema(schema).parquet(folder))
    rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
