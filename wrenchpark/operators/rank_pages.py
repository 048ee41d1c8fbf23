"""Numbered pages far down a list, read by rank.

``orderBy + offset + limit`` makes every task keep offset + limit rows.  For a
list that is paged often it is stored once in sorted ranges, many of them in a
folder (``ranges=``) and each in pages of its own there, with a directory of the
ranges' row counts.  A page's first rank then names the one or few ranges that hold
its rows; only their folders are opened, and only their Parquet pages read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_folders, write_folders
from .listing import page_bounds

#: Rows that a range holds; the last one of a folder may have fewer.
ROWS_PER_RANGE = 100_000
#: Rows that a folder should hold at least, however small its ranges are: tasks and
#: files follow the folders, which are as even as Spark's range sampling makes them.
ROWS_PER_FOLDER = 200_000
#: Rows of a Parquet page at most (the writer's default).
PAGE_ROWS = 20_000


def list_order() -> list[Column]:
    """Newest first; the id breaks ties."""
    return [F.col("created_at").desc(), F.col("id").desc()]


def write_ranked(rows: DataFrame, path: str, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Write ``rows`` in list order as ranges, and their directory (ranges, range, n, first_rank)."""
    spark = rows.sparkSession
    folders = max(1, -(-rows.count() // max(rows_per_range, ROWS_PER_FOLDER)))
    dealt = rows.repartitionByRange(folders, *list_order()).withColumn("ranges", F.spark_partition_id()).sortWithinPartitions("ranges", *list_order())
    # The low 33 bits count the rows of the task, in list order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("range", F.floor(place / rows_per_range).cast("long"))
    write_folders(dealt, f"{path}/rows", "ranges", **{"parquet.page.row.count.limit": min(rows_per_range, PAGE_ROWS)})
    # All ranges of a folder but the last are full, so only the folders are numbered by a window over all.
    counts = read_folders(spark, f"{path}/rows").groupBy("ranges", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("ranges").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("ranges").agg(F.sum("n").alias("all")).select("ranges", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("start"))
    counts.join(F.broadcast(starts), "ranges").select("ranges", "range", "n", (F.col("start") + F.col("range") * rows_per_range).alias("first_rank")).coalesce(1).write.parquet(
        f"{path}/directory")


def page_by_rank(spark: SparkSession, path: str, page=None, page_size=None) -> DataFrame:
    """The rows of a page in list order, from the ranges that hold its ranks."""
    offset, size = page_bounds(page, page_size)
    directory = spark.read.parquet(f"{path}/directory")
    held = directory.where((F.col("first_rank") < offset + size) & (F.col("first_rank") + F.col("n") > offset)).orderBy("first_rank").collect()
    rows = read_folders(spark, f"{path}/rows")
    if not held:
        return rows.drop("ranges", "range").limit(0)
    # A page of at most 200 rows touches few ranges, all next to each other.
    folders: dict[int, list[int]] = {}
    for r in held:
        folders.setdefault(r.ranges, []).append(r.range)
    wanted = reduce(or_, [(F.col("ranges") == f) & F.col("range").isin(of) for f, of in folders.items()])
    # Each alone reaches the folders and the files.
    wanted = wanted & F.col("ranges").isin(list(folders)) & F.col("range").isin(sorted({r.range for r in held}))
    rows = rows.where(wanted).drop("ranges", "range").orderBy(*list_order())
    skip = offset - held[0].first_rank
    return (rows.offset(skip) if skip else rows).limit(size)
