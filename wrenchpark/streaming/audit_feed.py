"""Append-only audit feed: parsed read-back and daily counts by action.

Batch and stream share the projection; the stream adds a watermark, drops
replayed rows by event id within the watermark and emits each closed day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(audit: DataFrame, ts: str = "logged_at", action: str = "action") -> DataFrame:
    """Rows per action and calendar day."""
    return (audit.groupBy(F.to_date(F.col(ts)).alias("day"), F.col(action).alias("action"))
            .agg(F.count(F.lit(1)).alias("n")))


def daily_counts_stream(audit: DataFrame, ts: str = "logged_at", action: str = "action",
                        id_col: str = "id", watermark: str = "1 hour") -> DataFrame:
    """Streaming daily counts (tumbling one-day windows, append mode).  Rows
    arriving later than the watermark are dropped; a replayed id inside the
    watermark is counted once."""
    e = audit.select(F.col(id_col), F.col(action).alias("action"), F.col(ts).cast("timestamp_ltz").alias("__ts"))
    e = e.withWatermark("__ts", watermark).dropDuplicatesWithinWatermark([id_col])
    agg = e.groupBy(F.window("__ts", "1 day").alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.to_date(F.col("w.start").cast("timestamp_ntz")).alias("day"), "action", "n")


def parsed_stream(audit: DataFrame) -> DataFrame:
    """Stateless projection of a streaming audit source (detail parsed)."""
    return audit.withColumn("detail_json", F.try_parse_json("detail"))
