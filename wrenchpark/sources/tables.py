"""Generic table access: Parquet, optional tables, JDBC, schema drift.

Everything returns lazy DataFrames; column lists are passed down so the scan
only reads what the job needs (Catalyst prunes further).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_conf


def table_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base: str, name: str,
               columns: Iterable[str] | None = None) -> DataFrame:
    """Parquet scan of ``base/name.parquet`` with an optional column list."""
    ensure_conf(spark)
    df = spark.read.parquet(table_path(base, name))
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the session, so it
    works for any scheme the cluster can read (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def optional_table(spark: SparkSession, path: str | None, schema: T.StructType,
                   table: str | None = None) -> DataFrame:
    """A table that may not exist yet (created by a later migration).

    Reads a catalog table or a Parquet path when present; otherwise returns a
    typed empty relation with the expected schema, so joins against it keep
    their shape (the priority catalog before the migration, for instance).
    """
    ensure_conf(spark)
    if table and spark.catalog.tableExists(table):
        return conform(spark.table(table), schema)
    if path and path_exists(spark, path):
        return conform(spark.read.parquet(path), schema)
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType,
            aliases: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Schema-tolerant projection onto ``schema``.

    For each target column the first existing name among the column itself
    and its ``aliases`` is used (cast to the target type); a column that is
    missing everywhere becomes a typed NULL.  This is how a table written
    before a migration, or with an older column name, is read.
    """
    present = set(df.columns)
    out: list[Column] = []
    for field in schema.fields:
        names = [field.name, *((aliases or {}).get(field.name, []))]
        found = next((n for n in names if n in present), None)
        expr = F.col(f"`{found}`") if found else F.lit(None)
        out.append(expr.cast(field.dataType).alias(field.name))
    return df.select(*out)


def write_folders(df: DataFrame, path: str, column: str, **options) -> None:
    """Write ``df`` in ``column=`` folders, with options of the Parquet writer.  Its schema goes beside them, so that
    a table without rows, which has no folder, can be read (:func:`read_folders`)."""
    df.limit(0).write.parquet(f"{path}-schema")
    df.write.options(**options).partitionBy(column).parquet(path)


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}-schema").schema).parquet(path)


def merged_table(spark: SparkSession, paths: Iterable[str], schema: T.StructType,
                 aliases: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """One table whose Parquet files were written before and after migrations.

    The files' schemas are merged in one read: a column that some files lack
    is NULL in their rows.  Where both generations name a column differently,
    the first of the names that has a value in a row gives it."""
    ensure_conf(spark)
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    present = set(df.columns)
    out: list[Column] = []
    for field in schema.fields:
        names = [n for n in (field.name, *((aliases or {}).get(field.name, []))) if n in present]
        expr = F.coalesce(*[F.col(f"`{n}`").cast(field.dataType) for n in names]) if names else F.lit(None).cast(field.dataType)
        out.append(expr.alias(field.name))
    return df.select(*out)


def jdbc_table(spark: SparkSession, url: str, table: str, *, user: str | None = None,
               password: str | None = None, driver: str | None = None,
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None,
               fetch_size: int = 10_000) -> DataFrame:
    """Read a database table through Spark's JDBC source.

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` range queries that run on the executors in parallel;
    without them the whole table comes through one connection, which is only
    acceptable for catalogs.
    """
    ensure_conf(spark)
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("fetchsize", str(fetch_size)))
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            reader = reader.option(key, value)
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("a partitioned JDBC read needs lower_bound, upper_bound and num_partitions")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    return reader.load()
