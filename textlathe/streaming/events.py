"""Structured Streaming over an event folder: windows, sessions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes", files: int = 8) -> DataFrame:
    """Events as they arrive in a folder; times become zoned ones, as watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table of files and read it."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True)
    if mode == "append":
        q.format("parquet").option("path", f"{folder}/{name}").start().awaitTermination()
        return stream.sparkSession.read.parquet(f"{folder}/{name}")
    q.format("memory").queryName(name).start().awaitTermination()
    return stream.sparkSession.table(name)
