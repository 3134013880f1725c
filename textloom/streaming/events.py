"""Windowed aggregation of event streams; added here, as corpora tools have no streams of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on batches and, with a watermark, on streams."""
    marked = events.withWatermark("ts", late) if late and events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n) per session of a user, closed by a gap."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
