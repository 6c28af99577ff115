"""Live price tracking (TB-14, our definition): hourly means per event type.

Structured Streaming over a folder of ``events``-shaped files: event time
``ts`` (read as timestamp_ntz, cast to timestamp in the session zone), a
2-hour watermark, 1-hour tumbling windows per ``event_type`` with the event
count and the exact mean ``value``, in append mode, so each window is written
once, after the watermark passes its end; rows later than the watermark are
dropped by Spark's state eviction.  State is bounded by the watermark, the
aggregation is shuffled by (window, type), and the sink and the checkpoint are
folders under the session's checkpoint root, so a restarted query resumes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.functions import exact_avg
from marketlens.session import checkpoint_root, remember

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
WATERMARK = "2 hours"
WINDOW = "1 hour"


def hourly_means(events: DataFrame, watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """Windowed aggregation; works on a stream (append mode) and on a batch."""
    ev = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        ev = ev.withWatermark("ts", watermark)
    agg = ev.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(exact_avg("value"), 9).alias("mean_value"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      "event_type", "events", "mean_value")


def event_stream(spark: SparkSession, folder: str, file_glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving anywhere below ``folder`` (sub-folders included)."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("recursiveFileLookup", "true")
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(folder)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, file_glob: str | None = None,
          available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the monitor writing parquet to ``sink`` (exactly-once with the checkpoint)."""
    out = hourly_means(event_stream(spark, source, file_glob))
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "1 minute")
    return writer.start(sink)


def run_available(spark: SparkSession, source: str, file_glob: str | None = None,
                  run_dir: str | None = None) -> DataFrame:
    """Process everything now in ``source`` and return what the sink holds.

    ``run_dir`` (default: a new folder under the checkpoint root) keeps sink and
    checkpoint; calling again with the same ``run_dir`` continues the stream.
    """
    base = run_dir or f"{checkpoint_root(spark)}/price-stream-{uuid.uuid4().hex}"
    if run_dir is None:
        remember(base)
    q = start(spark, source, f"{base}/sink", f"{base}/checkpoint", file_glob)
    q.awaitTermination()
    return spark.read.schema(
        "window_start timestamp_ntz, window_end timestamp_ntz, event_type string, events bigint, "
        "mean_value double").parquet(f"{base}/sink")
