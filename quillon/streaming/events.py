"""Streaming forms of block, sliding and session windows over an event stream (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def block_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and mean value by block of time and type; slide makes the blocks overlap."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events that lie within gap of each other."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
