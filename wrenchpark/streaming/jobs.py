"""Running the stream forms as jobs: Parquet folders in, Parquet out.

Each job reads new files of a folder (``maxFilesPerTrigger`` bounds a
micro-batch), keeps its progress and state in ``checkpoint`` (a shared
folder, so a restarted driver resumes where it stopped) and appends finished
rows to ``out``.  ``available_now`` processes what is there and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_dir, ensure_conf
from . import audit_feed, lockouts, sessions

ACTIVITY_SCHEMA = "user_id bigint, ts timestamp_ntz"
ATTEMPT_SCHEMA = "key string, ts timestamp_ntz, ok boolean, seq bigint"
AUDIT_SCHEMA = ("id bigint, job_id bigint, action string, detail string, actor_name string, actor_email string, "
                "ip string, user_agent string, logged_at timestamp_ntz")


def _source(spark: SparkSession, path: str, schema: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _sink(df: DataFrame, out: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_sessions(spark: SparkSession, src: str, out: str, checkpoint: str, gap: str = "30 minutes",
                 watermark: str = "1 hour", max_files: int | None = 100, available_now: bool = False) -> StreamingQuery:
    df = sessions.sessions_stream(_source(spark, src, ACTIVITY_SCHEMA, max_files), gap=gap, watermark=watermark)
    return _sink(df, out, checkpoint, available_now)


def run_lockouts(spark: SparkSession, src: str, out: str, checkpoint: str, max_failures: int = 5,
                 lock_seconds: int = 900, watermark: str = "1 hour", max_files: int | None = 100,
                 available_now: bool = False, idle_seconds: int | None = 7 * 24 * 3600) -> StreamingQuery:
    df = lockouts.lockouts_stream(_source(spark, src, ATTEMPT_SCHEMA, max_files), max_failures, lock_seconds,
                                  watermark, idle_seconds)
    return _sink(df, out, checkpoint, available_now)


def run_audit_daily(spark: SparkSession, src: str, out: str, checkpoint: str, watermark: str = "1 hour",
                    max_files: int | None = 100, available_now: bool = False) -> StreamingQuery:
    df = audit_feed.daily_counts_stream(_source(spark, src, AUDIT_SCHEMA, max_files), watermark=watermark)
    return _sink(df, out, checkpoint, available_now)


def replay(rows: DataFrame, ts: str, run: Callable[..., StreamingQuery], closing: dict, schema: str, slices: int = 2, **options) -> DataFrame:
    """A stream job's whole output over a finished table.

    The table is cut by time into ``slices``.  Each is added to the job's
    source folder, and the job is started, works off what is there and stops;
    the next start resumes from its checkpoint.  With the last slice comes one
    more row, ``closing`` with a time 90 days after all others, which moves the
    watermark past them and itself stays in the state.  Rows without a time
    are left out.  All folders are in the shared checkpoint folder.  The job runs in a session
    of its own, so that its settings stay there.

    Rows come in time order from slice to slice and in any order within one,
    so a run takes all new files as one batch: ``max_files`` is not set.
    """
    spark = rows.sparkSession
    own = ensure_conf(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    root = f"{checkpoint_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    src, out, progress = (f"{root}/{x}" for x in ("source", "out", "progress"))
    rows = rows.where(F.col(ts).isNotNull())
    span = rows.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).first()
    if span.low is None:
        return spark.createDataFrame([], schema)
    width = (span.high - span.low) / slices
    for i in range(slices):
        part = rows
        if i:
            part = part.where(F.col(ts) >= F.lit(span.low + i * width))
        if i < slices - 1:
            part = part.where(F.col(ts) < F.lit(span.low + (i + 1) * width))
        else:
            last = closing | {ts: span.high + timedelta(days=90)}
            part = part.unionByName(spark.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema]))
        part.write.mode("append").parquet(src)
        run(own, src, out, progress, available_now=True, max_files=None, **options).awaitTermination()
    return spark.read.schema(schema).parquet(out)
