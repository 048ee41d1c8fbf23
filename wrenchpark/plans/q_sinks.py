"""Registered queries: optional tables, what the sinks write read back, capped export, keyset page."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import exports as X
from ..operators import listing as L
from ..operators import reports as R
from ..session import checkpoint_dir
from ..sources.sinks import append_parquet, write_json
from ..sources.tables import optional_table, table_path
from ..sources.testdata import LIST_AS_OF, REPORT_TO, DriverModel
from .oracle import q
from .q_listing import EXPORT_SQL, LIST_FILTER
from .q_reports import RANGE_SQL, REPORT
from .registry import register

CURSOR = ("1998-01-01 12:00:00", 1000)


def _fresh(m: DriverModel, name: str) -> str:
    """A new folder beside the checkpoints, on the storage that all executors share."""
    return f"{checkpoint_dir(m.spark)}/{name}-{uuid.uuid4().hex}"


@register("optional_scan", "S2", q("""
SELECT o.o_orderkey AS id, c.c_name AS customer, CAST(NULL AS VARCHAR) AS warehouse
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
"""))
def optional_scan(m: DriverModel):
    """Orders with a table that exists and one that does not exist yet: its
    columns are NULL, the shape stays."""
    def names(table: str, key: str, name: str) -> DataFrame:
        schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(name, T.StringType())])
        return optional_table(m.spark, table_path(m.sf_dir, table), schema)

    orders = m.read("orders", ["o_orderkey", "o_custkey"])
    customers, warehouses = names("customer", "c_custkey", "c_name"), names("warehouse", "w_key", "w_name")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(warehouses, F.col("o_custkey") == F.col("w_key"), "left")
            .select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("customer"), F.col("w_name").alias("warehouse")))


def _part_sql(part: str, join: str, name: str) -> str:
    return (f"SELECT '{part}' AS part, {name} AS name, COUNT(*) AS total, CAST(NULL AS DECIMAL(38,2)) AS amount "
            f"FROM fj {join} GROUP BY {name}")


@register("report_json", "S9, A11", q(f"""
, fj AS (SELECT * FROM jobs WHERE {RANGE_SQL}), rows AS (
{_part_sql('by_status', 'JOIN statuses c ON c.id = fj.status_id', 'c.name')}
UNION ALL {_part_sql('by_type', 'JOIN types c ON c.id = fj.type_id', 'c.name')}
UNION ALL {_part_sql('by_location', 'JOIN locations c ON c.id = fj.location_id', 'c.name')}
UNION ALL {_part_sql('by_priority', 'LEFT JOIN priorities c ON c.id = fj.priority_id', "coalesce(c.name, 'Sin prioridad')")}
UNION ALL (SELECT 'top_providers', coalesce(nullif(trim(provider), ''), '—') AS name, COUNT(*) AS total,
                  CAST(SUM(coalesce(net_value, 0)) AS DECIMAL(38,2)) AS amount
           FROM fj GROUP BY 2 ORDER BY amount DESC, total DESC, name LIMIT {R.TOP_PROVIDERS})
)
SELECT part, CAST(ROW_NUMBER() OVER (PARTITION BY part ORDER BY amount DESC, total DESC, name) - 1 AS INTEGER) AS pos, name, total, amount
FROM rows
"""))
def report_json(m: DriverModel):
    """The report document written as JSON and read again: every entry of its arrays with its place."""
    doc = R.report_document(m.jobs, m.catalogs(), REPORT, REPORT_TO)
    path = _fresh(m, "report-json")
    write_json(doc, path)
    back = m.spark.read.schema(doc.schema).json(path)

    def part(name: str, label: str, amount) -> DataFrame:
        rows = back.select(F.posexplode(name).alias("pos", "e"))
        return rows.select(F.lit(name).alias("part"), "pos", F.col(f"e.{label}").alias("name"), F.col("e.total").alias("total"),
                           amount.cast("decimal(38,2)").alias("amount"))

    parts = [part(c, "name", F.lit(None)) for c in ("by_status", "by_type", "by_location", "by_priority")]
    return reduce(DataFrame.unionByName, [*parts, part("top_providers", "provider", F.col("e.amount"))])


@register("append_rows", "S10", q("SELECT id, job_id, comment, author_name FROM comments"))
def append_rows(m: DriverModel):
    """Comments appended in two batches to one table, read again."""
    path = _fresh(m, "append-rows")
    rows = m.comments.select("id", "job_id", "comment", "author_name")
    by_user = F.col("author_name").eqNullSafe("user")
    append_parquet(rows.where(by_user), path)
    append_parquet(rows.where(~by_user), path)
    return m.spark.read.parquet(path)


@register("export_capped", "T7", q(f"""
, e AS ({EXPORT_SQL.replace("SELECT id,", "SELECT s.created_at AS made_at, id,", 1)}
        ORDER BY s.created_at DESC, s.id DESC LIMIT 25)
SELECT * EXCLUDE (made_at) FROM e
"""))
def export_capped(m: DriverModel):
    """The newest 25 rows of the filtered export (the cap is the feature)."""
    return X.export_rows(m.jobs, m.catalogs(), LIST_FILTER, LIST_AS_OF, max_rows=25)


@register("list_after_cursor", "T2", q(f"""
SELECT id, created_at, status, job_type, location, priority FROM star
WHERE created_at < TIMESTAMP '{CURSOR[0]}' OR (created_at = TIMESTAMP '{CURSOR[0]}' AND id < {CURSOR[1]})
ORDER BY created_at DESC, id DESC LIMIT 50
"""))
def list_after_cursor(m: DriverModel):
    """The page after a given last row, whatever its depth."""
    rows = L.star(m.jobs, m.catalogs()).select("id", "created_at", "status", "job_type", "location", "priority")
    return L.after_cursor(rows, *CURSOR, size=50)
