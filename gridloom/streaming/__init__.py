"""An extension: event-time windows over streams, and the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, length: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Rows and sums by window and key; with ``late``, rows older than the watermark are dropped and state is bounded."""
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late) if late else df
    grouped = df.groupBy(F.window("_t", length, slide) if slide else F.window("_t", length), *keys)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    df = events.withColumn("_t", F.col(time).cast("timestamp"))
    df = df.withWatermark("_t", late) if late else df
    return df.groupBy(F.session_window("_t", gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def deduplicate(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")
