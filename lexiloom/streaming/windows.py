"""Incremental runs over files that keep arriving, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per window and type; what is later than ``late`` no longer counts."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def unique_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once, with state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Take in all files that are there and stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
