"""Incremental behaviour: file-stream ingest, request rates, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """New JSON-lines files of a folder; malformed lines go."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row of a key within the watermark's delay; state is dropped after it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, out: str, checkpoint: str):
    """Appends all that is available as Parquet and stops; the checkpoint makes it resumable."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def request_counts(events: DataFrame, key: str, ts: str, every: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Requests of every key in tumbling windows (batch or stream)."""
    e = events.withWatermark(ts, watermark) if watermark else events
    return e.groupBy(F.window(ts, every).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("window_start"), "n"
    )


def over_limit(counts: DataFrame, limit: int = 20) -> DataFrame:
    return counts.withColumn("rejected", F.greatest(F.lit(0), F.col("n") - limit))
