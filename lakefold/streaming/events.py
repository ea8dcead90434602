"""Event streams: windows by event time with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and value per event type and window."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of one user's events with no pause of `gap`."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; the state is dropped behind the watermark."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
