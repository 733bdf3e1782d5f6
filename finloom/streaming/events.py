"""Structured Streaming over append-only event logs; every operator equals its batch twin under availableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Parquet files as a stream with event time and watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def window_counts(events: DataFrame, key: str, width: str = "60 seconds", slide: str | None = None, ts: str = "ts") -> DataFrame:
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(span, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, keys) -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; state and progress live in the checkpoint folder."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fan_out(stream: DataFrame, checkpoint: str, sink) -> None:
    """Hand every micro-batch to sink(batch, batch_id)."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
