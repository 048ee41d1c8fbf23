"""Sinks: CSV export, JSON result, append of new rows, snapshot rewrite.

All writes run on the executors, one file per partition.  Tables that are
rewritten (snapshots after a batch of changes) go to a new path, never the
path being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.exports import EXPORT_COLUMNS, csv_field

BOM = "\ufeff"


def write_csv(rows: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """CSV with header through Spark's writer: fields are quoted exactly when
    they hold the separator, a quote, CR or LF; quotes are doubled; NULL and
    the empty string are both written empty; blanks are kept."""
    (rows.write.mode(mode)
         .option("sep", sep).option("header", True)
         .option("quote", '"').option("escape", '"')
         .option("nullValue", "").option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("dateFormat", "yyyy-MM-dd")
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
         .option("encoding", "UTF-8")
         .csv(path))


def write_csv_text(rows: DataFrame, path: str, sep: str = ";", mode: str = "overwrite",
                   columns: list[str] | None = None) -> None:
    """CSV as text lines with a byte-order mark before the header, for
    spreadsheet programs that need it to read UTF-8.  The header (with the
    mark) is the first line of the first file; rows keep their order when the
    input is sorted, because a sorted DataFrame is range partitioned."""
    cols = columns or [c for c in EXPORT_COLUMNS if c in rows.columns]
    spark = rows.sparkSession
    header = spark.createDataFrame([(0, BOM + sep.join(cols))], "part int, value string").coalesce(1)
    body = rows.select(F.lit(1).alias("part"), F.concat_ws(sep, *[csv_field(F.col(c)) for c in cols]).alias("value"))
    # The header is a one-row part placed first; the body keeps its partitions.
    header.select("value").unionAll(body.select("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    """Append rows (new jobs, comments, attachments, audit rows)."""
    df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new snapshot of a table to ``path`` (a fresh location)."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_jobs_table(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the job table for fast filtered reads: one folder per month of
    creation (partition pruning for date ranges) and rows sorted by creation
    time inside each file (Parquet min/max statistics then skip row groups).
    Rows are clustered by month before writing, so each task writes few files."""
    month = F.date_format("created_at", "yyyy-MM")
    (jobs.withColumn("created_month", month)
         .repartitionByRange("created_month", "created_at")
         .sortWithinPartitions("created_month", "created_at")
         .write.mode(mode).partitionBy("created_month").parquet(path))
