"""EXTENSION (not in the reference): streaming anomaly counts.

The reference fetches measurements on demand.  When measurement payloads
arrive continuously as files, the same counts (A1) can be kept up to date by
Structured Streaming: parse each new payload file (S8), bound the state with
a watermark, and count per (day, country, test) in tumbling windows.  Late
rows within the watermark update their day; later ones are dropped by Spark.

This module is labelled an extension: it adds no operator the reference has
and is not registered as a driver query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from commsight.sources.payloads import parse_measurements

PAYLOAD_SCHEMA = "country string, test string, body string"


def measurement_stream(spark: SparkSession, payload_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Parsed measurements from JSON-lines payload files as they land."""
    raw = (spark.readStream.schema(PAYLOAD_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(payload_dir))
    return parse_measurements(raw, keep=["country", "test"])


def daily_counts(measurements: DataFrame, watermark: str = "2 days", window: str = "1 day") -> DataFrame:
    """A1 per (day window, probe country, test) with a watermark on event time."""
    m = measurements.where(F.col("measurement_start_time").isNotNull())
    return (m.withWatermark("measurement_start_time", watermark)
            .groupBy(F.window("measurement_start_time", window).alias("day"), "probe_cc", "test_name")
            .agg(F.count_if(F.col("anomaly")).alias("anomalies"),
                 F.count_if(~F.col("anomaly")).alias("accessible")))


def start_daily_counts(spark: SparkSession, payload_dir: str, out_dir: str, checkpoint: str,
                       watermark: str = "2 days", available_now: bool = False) -> StreamingQuery:
    """Append finished day windows to Parquet at ``out_dir``.

    ``checkpoint`` must be on shared storage (the query's offsets and state
    live there, so a restarted driver or lost executor resumes exactly).
    """
    counts = daily_counts(measurement_stream(spark, payload_dir), watermark)
    flat = counts.select(F.col("day.start").alias("day_start"), F.col("day.end").alias("day_end"),
                         "probe_cc", "test_name", "anomalies", "accessible")
    w = flat.writeStream.outputMode("append").format("parquet").option("path", out_dir) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
