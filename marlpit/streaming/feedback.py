"""Feedback and diagnostics as append-only streams; an extension of the batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: str, late: str = "10 minutes") -> DataFrame:
    """New feedback files below ``path``; an event that was delivered twice counts once while its watermark lasts."""
    return spark.readStream.schema(schema).json(path).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Likes and dislikes by window."""
    return events.groupBy(F.window("ts", window)).agg(F.count_if("liked").alias("likes"), F.count_if(~F.col("liked")).alias("dislikes")).select("window.start", "window.end", "likes", "dislikes")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet log once and only once; ends when what is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
