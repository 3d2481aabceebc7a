"""Continuous ingestion of documents, and event windows. Beyond what batch parity needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import clean_lines
from tessera.sources.files import exists

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def ingest_documents(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Cleans new documents and appends those whose content isn't stored yet; replays of a batch add nothing.

    Each batch is anti-joined on the content hash with the table and deduplicated within itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        clean = rows.withColumn("text", clean_lines(F.coalesce("text", F.lit(""))))
        keyed = clean.withColumn("content_sha", F.sha2("text", 256)).dropDuplicates(["content_sha"])
        if exists(rows.sparkSession, target):
            keyed = keyed.join(rows.sparkSession.read.parquet(target).select("content_sha"), "content_sha", "left_anti")
        keyed.withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window; works on streams and on tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")
