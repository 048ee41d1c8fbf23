"""Activity sessions: a session ends after more than ``gap`` without events.

A gap of exactly ``gap`` keeps the session alive (the source closes a
session only when the idle time is strictly greater than the limit).

Batch form: an ordered scan per (key, time bucket) finds local session starts,
a summary row per bucket stitches sessions across bucket edges, and one
aggregate per (key, session number) gives the sessions.  A key with a third
of all events is spread over its buckets instead of landing on one task.

Stream form: ``session_window`` with a watermark, emitted in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _interval(gap: str):
    return F.expr(f"INTERVAL {gap}")


def session_numbers(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
                    bucket_unit: str = "hour") -> DataFrame:
    """Events with ``session_no`` (1, 2, ... within each key, in time order).
    Events without key or time belong to no session and are left out.

    The buckets and their summary use one exchange by (key, bucket); the null
    tests are stated here because the join below would add them to one side only."""
    g = _interval(gap)
    d = events.withColumn("__b", F.date_trunc(bucket_unit, F.col(ts)))
    d = d.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col("__b").isNotNull()).repartition(key, "__b")
    w = Window.partitionBy(key, "__b").orderBy(ts)
    prev = F.lag(ts).over(w)
    d = d.withColumn("__start", F.when(prev.isNull() | (F.col(ts) > prev + g), 1).otherwise(0))
    d = d.withColumn("__cum", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    summ = d.groupBy(key, "__b").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"),
                                     F.sum("__start").alias("__n"))
    wb = Window.partitionBy(key).orderBy("__b")
    prev_last = F.lag("__last").over(wb)
    summ = summ.withColumn("__first_new",
                           F.when(prev_last.isNull() | (F.col("__first") > prev_last + g), 1).otherwise(0))
    summ = summ.withColumn("__adj", F.col("__n") - 1 + F.col("__first_new"))
    carry = summ.select(key, "__b", "__first_new",
                        F.coalesce(F.sum("__adj").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                        .alias("__off"))
    out = d.join(carry, [key, "__b"])
    return (out.withColumn("session_no", F.col("__off") + F.col("__cum") - 1 + F.col("__first_new"))
            .drop("__b", "__start", "__cum", "__first_new", "__off"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
             bucket_unit: str = "hour") -> DataFrame:
    """One row per session: key, start, end (last event) and event count."""
    n = session_numbers(events.select(key, ts), key, ts, gap, bucket_unit)
    return n.groupBy(key, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
        F.count(F.lit(1)).alias("n_events"))


def sessions_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes",
                    watermark: str = "1 hour") -> DataFrame:
    """Streaming sessions.  ``withWatermark`` needs TIMESTAMP, so the NTZ time
    is read as UTC and the window bounds are turned back into NTZ."""
    e = events.select(key, F.col(ts).cast("timestamp_ltz").alias("__ts"))
    agg = (e.withWatermark("__ts", watermark)
           .groupBy(F.session_window("__ts", gap).alias("w"), key)
           .agg(F.min("__ts").alias("session_start"), F.max("__ts").alias("session_end"),
                F.count(F.lit(1)).alias("n_events")))
    return agg.select(key, F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                      F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


def expired(last_activity: DataFrame, now: str, idle: str = "30 minutes", ts: str = "last_activity") -> DataFrame:
    """Sessions whose idle time at ``now`` is strictly greater than ``idle``."""
    return last_activity.where(F.lit(now).cast("timestamp_ntz") - F.col(ts) > _interval(idle))
