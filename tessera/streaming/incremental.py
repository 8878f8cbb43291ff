"""Incremental indexing and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_new_files(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str) -> None:
    """Fingerprints of the Parquet files that have come since the last call are appended to `sink`."""
    rows = spark.readStream.schema(schema).parquet(source)
    out = rows.withColumn("fingerprint", F.sha2(F.coalesce("text", F.lit("")), 256)).select("doc_id", "fingerprint")
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each event_id; a stream keeps an id for `late` after its time, a table for good."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return rows.dropDuplicates(["event_id"])


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows, or sliding ones; runs on a stream (with a watermark) and on a table alike."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    counts = rows.groupBy(F.window("at", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", "total")
