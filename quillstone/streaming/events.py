"""Event-time windows over a stream of files, and an append sink. The batch forms are evt_tumbling and evt_sliding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; a window closes when the watermark passes its end."""
    w = F.window("ts", size, slide).alias("w")
    return events.withWatermark("ts", lateness).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs all available input into Parquet files, exactly once."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
