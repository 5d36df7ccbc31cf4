"""Structured Streaming: files as they come through the same column rules, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, steps: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> StreamingQuery:
    """Process the files that aren't done yet, then stop; run again, it goes on where it stood.

    The checkpoint remembers finished files, so that a lost driver or executor
    costs no more than the batch at hand. ``steps`` are rules without a shuffle
    over all rows.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return steps(reader.load(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _marked(events: DataFrame, time_col: str, late: str) -> DataFrame:
    """A stream with a watermark; times without a zone are read in the session's. A table stays as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)


def deduplicated(df: DataFrame, keys: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return df.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", value_col: str = "value", width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and their mean value by window and kind; works on a stream and on a table."""
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    df = _marked(events, time_col, late)
    out = df.groupBy(w.alias("w"), kind_col).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value_col), 6).alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), kind_col, "n", "mean_value")


def sessions(events: DataFrame, key_col: str = "user_id", time_col: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events without a gap of ``gap``."""
    df = _marked(events, time_col, late)
    out = df.groupBy(F.session_window(time_col, gap).alias("w"), key_col).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key_col, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
