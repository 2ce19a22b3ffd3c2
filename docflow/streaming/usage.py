"""Live page counts, token usage and request decoding on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.streaming.runner import run_updates_to_end, table_stream

WINDOW = "1 hour"


def usage_by_window(
    pages: DataFrame, event_time: str, window: str = WINDOW, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Pages and tokens per time window, for update mode.

    There is no watermark: a late page updates its window, and the newest
    window is there as soon as it has a page. State is one row per window and
    keys; it is kept on disk by the state store the session sets.
    """
    return (
        pages.groupBy(F.window(event_time, window).alias("_window"), *keys)
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        )
        .select(
            F.unix_micros("_window.start").alias("window_start_us"),
            *keys,
            "pages",
            "input_tokens",
            "output_tokens",
            "total_tokens",
        )
    )


def run_on_table(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of finished pages."""
    pages = table_stream(spark, f"{folder}/events.parquet", max_files=1).select(
        F.timestamp_micros(
            F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
        ).alias("finished_at"),
        "event_type",
        F.expr("257 + event_id % 865").alias("input_tokens"),
        F.expr("event_id % 400").alias("output_tokens"),
    )
    usage = usage_by_window(pages, "finished_at", keys=("event_type",))
    return run_updates_to_end(usage, "usage_by_window", ["window_start_us", "event_type"])
