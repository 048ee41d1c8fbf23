"""The summary report: KPIs, closing time, breakdowns and provider totals.

The source system runs seven separate queries over the same filtered set.
Here all counts share one scan through GROUPING SETS, from which KPIs, mean
and exact median (``percentile`` over the counts of distinct days) follow; the
provider totals are a second scan.  Each part is also a query of its own with
partial aggregation on every task and one tiny final merge.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import provider_key
from ..functions.timefmt import date_lit, midnights_between
from .dims import Dim, join_name
from .filters import JobFilter
from .listing import star

TOP_PROVIDERS = 10


def _closed(status_col: str = "status"):
    return F.lower(F.col(status_col)) == F.lit(S.CLOSED_STATUS)


def kpis(filtered: DataFrame, catalogs: Mapping[str, Dim], today: str) -> DataFrame:
    """total, open, closed (created in range and closed now) and overdue."""
    df = join_name(filtered, catalogs["status"], "status_id", "status")
    closed = _closed()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~closed).alias("open"),
        F.count_if(closed).alias("closed"),
        F.count_if(~closed & F.col("due_date").isNotNull() & (F.col("due_date") < date_lit(today)))
         .alias("overdue"),
    )


def closing_time(filtered: DataFrame, catalogs: Mapping[str, Dim]) -> DataFrame:
    """Mean and interpolated median of calendar days from creation to close,
    over closed rows.  No closed row gives one row of NULLs."""
    df = join_name(filtered, catalogs["status"], "status_id", "status").where(F.col("closed_at").isNotNull())
    d = midnights_between("created_at", "closed_at")
    return df.agg(F.avg(d.cast("double")).alias("avg_days_to_close"),
                  F.percentile(d, F.lit(0.5)).alias("median_days_to_close"))


def breakdown(filtered: DataFrame, catalogs: Mapping[str, Dim], dim: str) -> DataFrame:
    """Count by one catalog name, ordered by count desc then name."""
    if dim == "priority":
        df = star(filtered, catalogs, inner=False)
        key = F.coalesce(F.col("priority"), F.lit(S.NO_PRIORITY_LABEL))
    else:
        col = {"status": "status_id", "type": "type_id", "location": "location_id"}[dim]
        name = {"status": "status", "type": "job_type", "location": "location"}[dim]
        df = join_name(filtered, catalogs[dim], col, name)
        key = F.col(name)
    return (df.groupBy(key.alias("name")).agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.col("total").desc(), F.col("name").asc()))


def breakdown_all(filtered: DataFrame, catalogs: Mapping[str, Dim]) -> DataFrame:
    """All four breakdowns from one scan: GROUPING SETS over the star join.

    Rows carry ``dimension`` (status, type, location, priority), ``name`` and
    ``total``.  Catalog names come in by left joins, and a NULL name in the
    status, type or location set (a dangling id) is dropped afterwards, which
    is what the separate inner-join queries give.
    """
    df = filtered
    for col, name, key in (("status_id", "status", "status"), ("type_id", "job_type", "type"),
                           ("location_id", "location", "location"), ("priority_id", "priority", "priority")):
        df = join_name(df, catalogs[key], col, name, how="left")
    df = df.select("status", "job_type", "location",
                   F.coalesce(F.col("priority"), F.lit(S.NO_PRIORITY_LABEL)).alias("priority_label"))
    keys = ["status", "job_type", "location", "priority_label"]
    out = df.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"))
    # grouping_id bit is 1 for a column not in the set; first column = highest bit.
    gid_of = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    label = {"status": "status", "job_type": "type", "location": "location", "priority_label": "priority"}
    dimension = None
    name = None
    for k in keys:
        cond = F.col("gid") == F.lit(gid_of[k])
        dimension = F.when(cond, F.lit(label[k])) if dimension is None else dimension.when(cond, F.lit(label[k]))
        name = F.when(cond, F.col(k)) if name is None else name.when(cond, F.col(k))
    res = out.select(dimension.alias("dimension"), name.alias("name"), F.col("total"))
    return res.where(F.col("name").isNotNull())


def report_counts(filtered: DataFrame, catalogs: Mapping[str, Dim], today: str) -> DataFrame:
    """The breakdowns, and what KPIs and closing time need, from one scan: one
    GROUPING SETS aggregate of plain counts with a fifth set for the days to
    close (rows of a known status that were closed).  Rows carry ``part`` (status,
    type, location, priority, days), ``name`` or ``days``, ``total`` and ``overdue``
    (due before ``today``; of use in the status rows, where the name tells open
    from closed).  The result is bounded by catalog sizes and distinct day counts."""
    df = filtered
    for col, name, key in (("status_id", "status", "status"), ("type_id", "job_type", "type"),
                           ("location_id", "location", "location"), ("priority_id", "priority", "priority")):
        df = join_name(df, catalogs[key], col, name, how="left")
    df = df.select("status", "job_type", "location",
                   F.coalesce(F.col("priority"), F.lit(S.NO_PRIORITY_LABEL)).alias("priority_label"),
                   F.when(F.col("status").isNotNull() & F.col("closed_at").isNotNull(),
                          midnights_between("created_at", "closed_at")).alias("days"),
                   (F.col("due_date") < date_lit(today)).alias("late"))
    labels = {"status": "status", "job_type": "type", "location": "location", "priority_label": "priority", "days": "days"}
    keys = list(labels)
    out = df.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("late")).alias("overdue"))
    # In the grouping id the bit of the one column that is in the set is 0; the first column has the highest bit.
    every = (1 << len(keys)) - 1
    part = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (every - (1 << (len(keys) - 1 - i)), labels[k])])
    rows = out.select(part[F.col("gid").cast("int")].alias("part"),
                      F.coalesce("status", "job_type", "location", "priority_label").alias("name"), "days", "total", "overdue")
    return rows.where(F.col("name").isNotNull() | F.col("days").isNotNull())


def top_providers(filtered: DataFrame, k: int = TOP_PROVIDERS, collation: str | None = None) -> DataFrame:
    """Provider totals: trimmed name (blank or NULL as the dash), count and sum
    of net value (NULL as 0); top ``k`` by amount, count, then name.

    Grouping is binary by default; ``collation='UNICODE_CI'`` groups names
    that differ only in case, as a case-insensitive database would.  Of a group's
    spellings the smallest in binary order is shown."""
    key = provider_key("provider", S.NO_PROVIDER_LABEL)
    agg = filtered.groupBy(key.alias("provider")).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.coalesce(F.col("net_value"), F.lit(0).cast("decimal(12,2)"))).cast("decimal(38,2)")
         .alias("amount"))
    if collation:
        # Rows are added up by exact name in a hash table; only the sums of distinct names are grouped by the collation, which sorts.
        agg = agg.groupBy(F.collate("provider", collation).alias("__name")).agg(
            F.min("provider").alias("provider"), F.sum("total").alias("total"), F.sum("amount").cast("decimal(38,2)").alias("amount")).drop("__name")
    return agg.orderBy(F.col("amount").desc(), F.col("total").desc(), F.col("provider").asc()).limit(k)


def report_filter(filt: JobFilter, today: str) -> JobFilter:
    return filt.with_default_range(today)


def report_document(jobs: DataFrame, catalogs: Mapping[str, Dim], filt: JobFilter,
                    today: str) -> DataFrame:
    """The whole report as one row: range, kpis (with mean and median) and the
    five breakdown arrays.

    Two scans of the fact: one for all counts (:func:`report_counts`), one for
    the top-k providers.  Both results are united and folded by one global
    aggregate, so no part is ever larger than a catalog, the distinct days to
    close or k rows.  No row in range gives zero counts, NULL mean and median
    and empty arrays.
    """
    f = report_filter(filt, today)
    filtered = f.apply(jobs)
    lo, hi = f.range()
    counts = report_counts(filtered, catalogs, today)
    tp = top_providers(filtered).select(F.lit("providers").alias("part"), F.col("provider").alias("name"), "total", "amount")
    parts = counts.unionByName(tp, allowMissingColumns=True)

    def tally(cond, column: str = "total"):
        return F.coalesce(F.sum(F.when(cond, F.col(column))), F.lit(0).cast("bigint"))

    by_status = F.col("part") == "status"
    closed = by_status & (F.lower("name") == F.lit(S.CLOSED_STATUS))
    still_open = by_status & (F.lower("name") != F.lit(S.CLOSED_STATUS))
    by_days = F.col("part") == "days"
    kpi = F.struct(
        tally(by_status).alias("total"), tally(still_open).alias("open"), tally(closed).alias("closed"),
        tally(still_open, "overdue").alias("overdue"),
        F.try_divide(F.sum(F.when(by_days, F.col("days") * F.col("total"))),
                     F.sum(F.when(by_days, F.col("total")))).cast("double").alias("avg_days_to_close"),
        F.percentile(F.col("days"), F.lit(0.5), F.col("total")).alias("median_days_to_close"))

    def ordered(dim: str):
        # sort_array on (-total, name) gives count desc, then name.
        arr = F.sort_array(F.collect_list(F.when(F.col("part") == dim, F.struct(
            (-F.col("total")).alias("k"), F.col("name").alias("name"),
            F.col("total").alias("total")))))
        return F.transform(arr, lambda x: F.struct(x["name"].alias("name"), x["total"].alias("total")))

    providers = F.sort_array(F.collect_list(F.when(F.col("part") == "providers", F.struct(
        (-F.col("amount")).alias("a"), (-F.col("total")).alias("t"),
        F.col("name").alias("provider"), F.col("amount").alias("amount"),
        F.col("total").alias("total")))))
    return parts.agg(
        F.struct(F.lit(lo).alias("from"), F.lit(hi).alias("to")).alias("range"),
        kpi.alias("kpis"),
        ordered("status").alias("by_status"),
        ordered("type").alias("by_type"),
        ordered("location").alias("by_location"),
        ordered("priority").alias("by_priority"),
        F.transform(providers, lambda x: F.struct(x["provider"].alias("provider"), x["total"].alias("total"),
                                                  x["amount"].alias("amount"))).alias("top_providers"),
    )


def report_json(doc: DataFrame) -> DataFrame:
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("report"))
