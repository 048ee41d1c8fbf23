"""Work-order tables derived from the driver's synthetic tables.

The driver ships TPC-H-like tables, not work orders.  This module maps them
onto the work-order model (see FIXTURES.md) with plain DataFrame expressions:
every table here is a lazy projection / join of the given Parquet files, so
its size grows with the scale factor and Catalyst prunes and pushes filters
into the scans.  Modulo rules only make NULLs, blanks and dirty text that the
source tables lack; they never drop rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.dims import Dim
from ..session import ensure_conf
from .tables import read_table

# --- Fixed values of the driver tables (not of the work-order model) ---
# Order priorities of the synthetic orders; '4-NOT SPECIFIED' stands for "no priority".
ORDER_PRIORITIES = [(1, "1-URGENT"), (2, "2-HIGH"), (3, "3-MEDIUM"), (5, "5-LOW")]
# Order status letter to status id (F = Cerrado, P = En curso, anything else = Pendiente).
ORDER_STATUS_TO_ID = {"F": 3, "P": 2}
# Event type to the status a change event asks for; 'error' asks for an unknown status.
EVENT_TO_STATUS = {"view": 1, "click": 2, "purchase": 3, "signup": 4, "error": 99}
# lineitem return flag to attachment group.
FLAG_TO_GROUP = {"A": "antes", "N": "despues", "R": "evidencia"}
MIME_BY_MOD4 = ["image/jpeg", "image/png", "image/webp", "application/pdf"]
# --- end of fixed values ---

# Clocks used by the fixed queries (FIXTURES.md section 2).
LIST_AS_OF = "2001-08-15 12:00:00"
REPORT_FROM = "1998-01-01"
REPORT_TO = "1998-06-30"
SESSION_GAP = "12 hours"
LOCK_MAX_FAILURES = 3
LOCK_DURATION = "12 hours"
LOCK_SECONDS = 12 * 3600


def _hours(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), c.cast("int"))


def _days(c: Column) -> Column:
    return F.make_dt_interval(c.cast("int"))


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(col == F.lit(key), F.lit(value)) if expr is None
                else expr.when(col == F.lit(key), F.lit(value)))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


class DriverModel:
    """Lazy work-order tables over ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_conf(spark)
        self.sf_dir = sf_dir

    def read(self, name: str, columns=None) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, columns)

    # ----- catalogs -----
    @cached_property
    def statuses(self) -> Dim:
        return Dim(self.spark.createDataFrame(S.STATUS_SEED, S.CATALOG), len(S.STATUS_SEED))

    @cached_property
    def priorities(self) -> Dim:
        return Dim(self.spark.createDataFrame(ORDER_PRIORITIES, S.CATALOG), len(ORDER_PRIORITIES))

    @cached_property
    def locations(self) -> Dim:
        nation = self.read("nation", ["n_nationkey", "n_name"])
        return Dim(nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")))

    @cached_property
    def types(self) -> Dim:
        # One id for each distinct segment, numbered in name order.  The
        # distinct runs as a partial + final aggregate; only the distinct names
        # (a catalog) reach the numbering window.
        names = self.read("customer", ["c_mktsegment"]).select(F.col("c_mktsegment").alias("name")).distinct()
        numbered = names.select(F.dense_rank().over(Window.orderBy("name")).cast("int").alias("id"), "name")
        return Dim(numbered)

    def catalogs(self) -> dict[str, Dim]:
        return {"status": self.statuses, "type": self.types,
                "location": self.locations, "priority": self.priorities}

    # ----- facts -----
    @cached_property
    def jobs(self) -> DataFrame:
        o = self.read("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                 "o_orderdate", "o_orderpriority"])
        c = self.read("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
        types = self.types.for_join().select(F.col("id").alias("type_id"), F.col("name").alias("c_mktsegment"))
        k = F.col("o_orderkey")
        odate = F.col("o_orderdate")
        closed_at = F.when((F.col("o_orderstatus") == "F") & (k % 17 != 0),
                           odate + _days(k % 45) + _hours(k % 19))
        joined = o.join(c, o.o_custkey == c.c_custkey).join(types, "c_mktsegment")
        return joined.select(
            k.alias("id"),
            (odate + _hours(k % 24)).alias("created_at"),
            F.when(k % 8 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("created_by_name"),
            F.when(k % 6 == 0, F.lit(None))
             .otherwise(F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.cl")))
             .alias("created_by_email"),
            F.when(k % 13 == 0, F.lit(None)).when(k % 11 == 0, F.lit("   "))
             .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("provider"),
            F.concat(F.col("c_mktsegment"), F.lit(" job "), k.cast("string")).alias("description"),
            F.col("c_nationkey").cast("int").alias("location_id"),
            F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("OC-"), k.cast("string")))
             .alias("purchase_order"),
            F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice").cast("decimal(12,2)"))
             .alias("net_value"),
            F.col("type_id").cast("int").alias("type_id"),
            _case(F.col("o_orderstatus"), ORDER_STATUS_TO_ID, 1).cast("int").alias("status_id"),
            F.to_date(closed_at).alias("repair_date"),
            F.when(k % 4 == 0, F.lit(None))
             .otherwise(F.concat(F.lit("Clerk#"), (F.col("o_custkey") % 50).cast("string")))
             .alias("requested_by"),
            closed_at.alias("closed_at"),
            F.when(k % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("Nota "), F.col("o_orderpriority")))
             .alias("notes"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None))
             .otherwise(F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority_id"),
            F.when(k % 5 == 0, F.lit(None)).otherwise(F.date_add(F.to_date(odate), (k % 60).cast("int")))
             .alias("due_date"),
            F.when(k % 10 < 3, F.concat(F.lit("Tecnico "), (k % 7).cast("string"))).alias("owner_name"),
            F.when(k % 10 < 2, F.concat(F.lit("tecnico"), (k % 7).cast("string"), F.lit("@example.cl")))
             .alias("owner_email"),
        )

    @cached_property
    def attachments(self) -> DataFrame:
        """lineitem as attachment rows: order = job, return flag = group."""
        li = self.read("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                    "l_quantity", "l_returnflag", "l_shipdate"])
        return li.select(
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(1_000_000_000)
             + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("id"),
            F.col("l_orderkey").alias("job_id"),
            _case(F.col("l_returnflag"), FLAG_TO_GROUP, "evidencia").alias("group"),
            F.concat(F.lit("/uploads/"), F.date_format("l_shipdate", "yyyy-MM"), F.lit("/"),
                     F.col("l_orderkey").cast("string"), F.lit("_"),
                     F.date_format("l_shipdate", "yyyyMMdd"), F.lit("_"),
                     F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
                     F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".jpg")).alias("file_path"),
            F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit(".jpg")).alias("original_name"),
            F.col("l_shipdate").alias("uploaded_at"),
            _case((F.col("l_partkey") % 4).cast("int"), dict(enumerate(MIME_BY_MOD4))).alias("mime_type"),
            (F.col("l_quantity") * F.lit(110_000)).cast("bigint").alias("size_bytes"),
            F.col("l_quantity").alias("quantity"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        conv = self.read("conversations", ["conv_id", "turn", "role", "text"])
        return conv.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            F.col("conv_id").alias("job_id"),
            F.col("text").alias("comment"),
            F.col("role").alias("author_name"),
            F.concat(F.col("role"), F.lit("@example.cl")).alias("author_email"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + _hours(F.col("conv_id") % 720)
             + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("created_at"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        ev = self.read("events", ["event_id", "ts", "user_id", "event_type", "props"])
        return ev.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("job_id"),
            F.col("event_type").alias("action"), F.col("props").alias("detail"),
            F.lit(None).cast("string").alias("actor_name"), F.lit(None).cast("string").alias("actor_email"),
            F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1")).alias("ip"),
            F.lit("agent").alias("user_agent"),
            F.col("ts").alias("logged_at"),
        )

    @cached_property
    def status_changes(self) -> DataFrame:
        ev = self.read("events", ["event_id", "ts", "user_id", "event_type"])
        return ev.select(
            F.col("user_id").alias("job_id"),
            _case(F.col("event_type"), EVENT_TO_STATUS).cast("int").alias("status_id"),
            F.col("ts"), F.col("event_id").alias("seq"),
        )

    @cached_property
    def login_attempts(self) -> DataFrame:
        ev = self.read("events", ["event_id", "ts", "user_id", "event_type"])
        return (ev.where(F.col("event_type").isin("error", "purchase"))
                .select(F.col("user_id").cast("string").alias("key"), F.col("ts"),
                        (F.col("event_type") == "purchase").alias("ok"),
                        F.col("event_id").alias("seq")))

    @cached_property
    def activity(self) -> DataFrame:
        return self.read("events", ["user_id", "ts"])

    @cached_property
    def incoming_comments(self) -> DataFrame:
        """Comments posted to jobs: some parents do not exist, turn 3 is blank."""
        conv = self.read("conversations", ["conv_id", "turn", "text"])
        return conv.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_seq"),
            (F.col("conv_id") * 211 + F.col("turn")).alias("job_id"),
            F.when(F.col("turn") == 3, F.lit("   ")).otherwise(F.col("text")).alias("comment"),
        )

    @cached_property
    def incoming(self) -> DataFrame:
        """Form-like text records (one per order) with dirty values by rule."""
        o = self.read("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
        c = self.read("customer", ["c_custkey", "c_name", "c_nationkey"])
        k = F.col("o_orderkey")
        iso = F.date_format("o_orderdate", "yyyy-MM-dd")
        money = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
        j = o.join(c, o.o_custkey == c.c_custkey)
        return j.select(
            k.alias("record_id"),
            F.when(k % 10 == 0, F.lit("   ")).when(k % 10 == 1, F.lit(None))
             .otherwise(F.concat(F.lit("  Job "), k.cast("string"), F.lit(" "))).alias("description"),
            F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.lit("abc")).when(k % 9 == 2, F.lit("0"))
             .when(k % 9 == 3, F.lit("1.0000000001")).when(k % 9 == 4, F.lit("1.00000000000000000001"))
             .when(k % 9 == 5, F.lit("250e-1")).when(k % 45 == 6, F.lit("1e400")).when(k % 45 == 15, F.lit("3000000000"))
             .otherwise(F.col("c_nationkey").cast("string")).alias("location_id"),
            F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.lit("7.0"))
             .otherwise(((k % 5) + 1).cast("string")).alias("type_id"),
            F.when(k % 4 == 0, F.lit("")).otherwise(((k % 4) + 1).cast("string")).alias("status_id"),
            F.when(k % 8 == 0, F.lit("12,5")).when(k % 8 == 1, F.lit("1.234,5")).when(k % 8 == 2, F.lit("abc"))
             .when(k % 8 == 3, F.lit("1e3")).when(k % 8 == 4, F.lit("")).otherwise(money).alias("net_value"),
            F.col("c_name").alias("created_by_name"),
            F.when(k % 6 == 0, F.lit("a@b")).when(k % 6 == 1, F.lit(" ana@example.cl "))
             .when(k % 6 == 2, F.lit("bad @x.cl")).otherwise(F.lit(None)).alias("created_by_email"),
            F.when(k % 7 == 0, F.lit("2024-02-30")).when(k % 7 == 1, F.lit("24-1-1"))
             .when(k % 7 == 2, F.lit(None)).otherwise(iso).alias("repair_date"),
            F.when(k % 5 == 0, F.lit("")).otherwise(F.substring("o_orderpriority", 1, 1)).alias("priority_id"),
            F.when(k % 12 == 0, F.lit("2024-13-01")).otherwise(iso).alias("due_date"),
            F.lit(None).cast("string").alias("owner_name"),
            F.when(k % 10 == 3, F.lit("tec@example")).when(k % 10 == 4, F.lit("tec@example.cl"))
             .otherwise(F.lit(None)).alias("owner_email"),
            F.concat(F.lit(" "), F.col("c_name")).alias("provider"),
            F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("OC-"), k.cast("string"))).alias("purchase_order"),
            F.lit(None).cast("string").alias("requested_by"),
            F.lit(None).cast("string").alias("notes"),
        )


    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views of the work-order tables and catalogs, for SQL users:
        ``jobs``, ``statuses``, ``types``, ``locations``, ``priorities``,
        ``attachments``, ``comments``, ``audit``."""
        views = {"jobs": self.jobs, "attachments": self.attachments, "comments": self.comments,
                 "audit": self.audit, "statuses": self.statuses.df, "types": self.types.df,
                 "locations": self.locations.df, "priorities": self.priorities.df}
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in views]


def model(spark: SparkSession, sf_dir: str) -> DriverModel:
    return DriverModel(spark, sf_dir)

