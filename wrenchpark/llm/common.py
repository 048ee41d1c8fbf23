"""Reading, staging and batch settings shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds, so that a worker's memory does not follow the text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor makes Spark read the written files
    again instead of redoing the work before them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``size`` bytes in each (always at least one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column)).cast(pa.large_binary())
        o = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(o, o[start] + size, side="right")) - 1
            end = min(b.num_rows, max(end, start + 1))
            yield b.slice(start, end - start)
            start = end
