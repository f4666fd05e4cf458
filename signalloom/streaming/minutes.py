"""Minute features over a stream of events: the batch aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_features(events: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Counts and sums a window of distinct events; late ones within ``delay`` still count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    else:
        timed = timed.dropDuplicates(["event_id"])
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(
        F.unix_millis("window.start").alias("minute_ms"), "event_type", "n", F.round("v", 6).alias("v"),
    )


def replay(spark, path: str, schema, checkpoint: str, table: str) -> None:
    """Run all files of ``path`` through the stream once, into an in-memory table."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = minute_features(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
