"""Streams of events: windows with a watermark, first arrivals, latest state. The same functions serve batch tables.

An extension: the reference behaviour is batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, users' values summed and errors per tumbling window and type; rows later than the watermark are left out of a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("inicio"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """A row per user and run of events without a gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("inicio"), F.col("w.end").alias("fim"), "n")


def first_arrivals(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
