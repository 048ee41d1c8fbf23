"""Job list: star join to the catalogs, row enrichment, total and pages.

Catalog joins are broadcast hash joins (size-checked), so the fact table is
never shuffled for them.  The page is a sort + offset + limit, which Spark
plans as a TakeOrderedAndProject: each task keeps only its best
``offset + limit`` rows, and only those reach the final merge.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.timefmt import days_open, fmt_date, fmt_ts, overdue, ts_lit
from .dims import Dim, join_name
from .filters import JobFilter, by_id, to_int_or_none

PAGE_SIZE_DEFAULT = 100
PAGE_SIZE_MIN = 5
PAGE_SIZE_MAX = 200

#: Groups that a large job's rows are dealt into to find its newest attachments, the rows a job has
#: before it counts as large (and, on average, in a piece of a large job's list), and the nested columns.
NEST_SALTS = 16
NEST_FEW = 10_000
NEST_FIELDS = ["id", "file_path", "group", "original_name"]

LIST_COLUMNS = ["id", "created_at", "provider", "description", "purchase_order", "net_value",
                "repair_date", "requested_by", "closed_at", "priority_id", "due_date",
                "owner_name", "owner_email", "status", "job_type", "location", "priority"]


def star(jobs: DataFrame, catalogs: Mapping[str, Dim], inner: bool = True,
         with_priority: bool = True) -> DataFrame:
    """Jobs with catalog names: status, type and location by inner join,
    priority by left join (the key may be NULL)."""
    df = jobs
    if inner:
        df = join_name(df, catalogs["status"], "status_id", "status")
        df = join_name(df, catalogs["type"], "type_id", "job_type")
        df = join_name(df, catalogs["location"], "location_id", "location")
    if with_priority:
        df = join_name(df, catalogs["priority"], "priority_id", "priority", how="left")
    return df


def enrich(df: DataFrame, as_of: str, status_col: str = "status") -> DataFrame:
    """Add ``days_open`` and ``overdue`` for the clock ``as_of``."""
    now = ts_lit(as_of)
    return (df.withColumn("days_open", days_open("created_at", now))
              .withColumn("overdue", overdue("due_date", status_col, now)))


def list_rows(jobs: DataFrame, catalogs: Mapping[str, Dim], filt: JobFilter | None = None,
              as_of: str | None = None) -> DataFrame:
    """List rows (fact columns and catalog names), optionally enriched."""
    df = star((filt or JobFilter()).apply(jobs), catalogs).select(*LIST_COLUMNS)
    return enrich(df, as_of) if as_of else df


def list_total(jobs: DataFrame, filt: JobFilter | None = None) -> DataFrame:
    """Row count of the filter on the fact alone (no catalog join), like the
    source system's page total."""
    return (filt or JobFilter()).apply(jobs).agg(F.count(F.lit(1)).alias("total"))


def page_bounds(page=None, page_size=None) -> tuple[int, int]:
    """(offset, size) from raw page parameters: page >= 1, size 5..200."""
    p = to_int_or_none(page)
    p = max(1, p) if p else 1
    n = to_int_or_none(page_size)
    n = min(PAGE_SIZE_MAX, max(PAGE_SIZE_MIN, n if n else PAGE_SIZE_DEFAULT))
    return (p - 1) * n, n


def newest_first(df: DataFrame) -> DataFrame:
    """Newest first; the id breaks ties so pages never overlap."""
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc())


def list_page(rows: DataFrame, page=None, page_size=None) -> DataFrame:
    offset, size = page_bounds(page, page_size)
    ordered = newest_first(rows)
    return (ordered.offset(offset) if offset else ordered).limit(size)


def after_cursor(rows: DataFrame, created_at: str, job_id: int, size: int) -> DataFrame:
    """Keyset page: rows strictly after the cursor (created_at, id) in list
    order.  Deep pages cost the same as the first one."""
    cur = ts_lit(created_at)
    pred = (F.col("created_at") < cur) | ((F.col("created_at") == cur) & (F.col("id") < F.lit(job_id)))
    return newest_first(rows.where(pred)).limit(size)


def status_bucket(status: str | Column = "status") -> Column:
    """Display bucket of a status name: closed, in progress, pending, other."""
    s = F.lower(F.col(status) if isinstance(status, str) else status)
    return (F.when(s == "cerrado", F.lit("closed"))
             .when(s.isin("en curso", "en_curso"), F.lit("in_progress"))
             .when(s == "pendiente", F.lit("pending"))
             .otherwise(F.lit("other")))


def catalog_rows(catalogs: Mapping[str, Dim]) -> DataFrame:
    """(catalog, pos, id, name): locations by name, the other catalogs by id."""
    parts = [dim.df.select(F.lit(name).alias("catalog"), "id", "name",
                           (F.col("name") if name == "location" else F.lit("")).alias("__by")) for name, dim in catalogs.items()]
    w = Window.partitionBy("catalog").orderBy("__by", "id")
    rows = reduce(DataFrame.unionByName, parts).withColumn("pos", F.row_number().over(w))
    return rows.select("catalog", "pos", "id", "name").orderBy("catalog", "pos")


def newest_attachments(attachments: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest attachments of each job, as rows.

    Rows of jobs with more than ``NEST_FEW`` (or ``NEST_SALTS`` times ``most``) are first
    ranked in salted groups, of which each keeps its best ``most`` (tasks drop the
    others before the shuffle), so no more than that many rows of a job ever meet,
    whatever it has.  All other rows are shuffled once."""
    newest = F.struct(*[F.col(c) for c in NEST_FIELDS]).desc()

    def best(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(newest)
        return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank")

    rows = attachments.select("job_id", *NEST_FIELDS)
    # There are few such jobs: one for each NEST_FEW rows at most.
    large = attachment_counts(attachments).where(F.col("__total") > max(NEST_FEW, NEST_SALTS * most)).select(F.col("job_id").alias("__large"))
    of_large = F.col("job_id").eqNullSafe(F.col("__large"))
    salted = rows.join(F.broadcast(large), of_large, "left_semi").withColumn("__salt", F.pmod(F.xxhash64(*NEST_FIELDS), F.lit(NEST_SALTS)))
    return best(rows.join(F.broadcast(large), of_large, "left_anti").unionByName(best(salted, "job_id", "__salt").drop("__salt")), "job_id")


def attachment_counts(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("job_id").agg(F.count(F.lit(1)).alias("__total"))


def attachment_pieces(attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every attachment of a job with the piece of the job's list that it is in
    (``__piece``), and where the pieces of large jobs start (job_id, ``__piece``, first).

    The list of a job with more than ``NEST_FEW`` rows is cut behind about one in ``NEST_FEW``
    of its distinct rows, chosen by their hash.  Pieces are numbered in the order of the
    list, newest first; equal rows share one."""
    rows = attachments.where(F.col("job_id").isNotNull()).select("job_id", *NEST_FIELDS)
    row = F.struct(*[F.col(c) for c in NEST_FIELDS])
    # Both are broadcast: there are a large job and a cut for each NEST_FEW rows, or fewer.
    large = attachment_counts(rows).where(F.col("__total") > NEST_FEW).select(F.col("job_id").alias("__large"))
    of_large = F.col("job_id") == F.col("__large")
    cuts = (rows.where(F.pmod(F.xxhash64(*NEST_FIELDS), F.lit(NEST_FEW)) == 0).join(F.broadcast(large), of_large, "left_semi")
            .groupBy(F.col("job_id").alias("__large")).agg(F.sort_array(F.collect_set(row), asc=False).alias("__cuts"))
            .withColumn("__steps", F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda step: step <= F.size("__cuts"))))
    # How many cuts are newer than the row, by halving; behind the array's end get() is NULL.
    newer = F.reduce("__steps", F.lit(0), lambda n, step: F.when(F.get("__cuts", n + step - 1) > row, n + step).otherwise(n))
    of_cut = F.col("__cuts").isNotNull()
    placed = rows.join(F.broadcast(cuts), of_large, "left").withColumn("__piece", F.coalesce(F.when(of_cut, newer), F.lit(0)))
    before = Window.partitionBy("job_id").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.where(of_cut).groupBy("job_id", "__piece").agg(F.count(F.lit(1)).alias("__n"))
              .select("job_id", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("first")))
    return placed.drop("__large", "__cuts", "__steps"), starts


def nested_attachments(jobs: DataFrame, attachments: DataFrame, most: int | None = None) -> DataFrame:
    """(id, first, attachments, more): each job with all of its attachments nested,
    newest first; an empty array when it has none.

    A job with more than ``NEST_FEW`` of them has a row for each piece of its list, so that no
    array needs to hold a large job; ``first`` is the place of a row's first attachment in the
    list.  With ``most`` a job has one row with its ``most`` newest ones only, and ``more`` is
    how many it has beyond them (0 else)."""
    if most is None:
        pieces, starts = attachment_pieces(attachments)
        per = pieces.groupBy("job_id", "__piece").agg(attachments_newest_first().alias("attachments"))
        # Jobs get their pieces first: one exchange by job and piece then serves the nests and their join.
        starts = starts.select(F.col("job_id").alias("__job"), F.col("__piece").alias("__at"), "first")
        placed = jobs.select("id").join(F.broadcast(starts), F.col("id") == F.col("__job"), "left")
        placed = placed.select("id", F.coalesce("__at", F.lit(0)).alias("__at"), F.coalesce("first", F.lit(0)).cast("bigint").alias("first"))
        # The size of lists is not known before they are made, so they are never broadcast.
        nested = placed.join(per.hint("merge"), (F.col("id") == per.job_id) & (F.col("__at") == F.col("__piece")), "left").withColumn("more", F.lit(0).cast("bigint"))
    else:
        per = newest_attachments(attachments, most).groupBy("job_id").agg(attachments_newest_first().alias("attachments"))
        both = per.join(attachment_counts(attachments), "job_id")
        nested = jobs.select("id", F.lit(0).cast("bigint").alias("first")).join(both, F.col("id") == both.job_id, "left")
        nested = nested.withColumn("more", F.coalesce(F.col("__total") - F.size("attachments"), F.lit(0)).cast("bigint"))
    kind = per.schema["attachments"].dataType
    return nested.select("id", "first", F.coalesce("attachments", F.array().cast(kind)).alias("attachments"), "more")


def detail_row(jobs: DataFrame, catalogs: Mapping[str, Dim]) -> DataFrame:
    """Detail projection: every fact column, formatted dates and names."""
    df = star(jobs, catalogs)
    return df.select(
        *[F.col(c) for c in S.JOB_COLUMNS],
        fmt_ts("created_at").alias("created_at_str"),
        fmt_ts("closed_at").alias("closed_at_str"),
        fmt_date("due_date").alias("due_date_str"),
        F.col("status").alias("status_name"), F.col("job_type").alias("type_name"),
        F.col("location").alias("location_name"), F.col("priority").alias("priority_name"),
    )


def attachments_newest_first() -> Column:
    """Attachment structs of a group, newest (highest id) first; the whole row
    breaks ties."""
    return F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in NEST_FIELDS])), asc=False)


def job_detail(jobs: DataFrame, catalogs: Mapping[str, Dim], attachments: DataFrame,
               job_id, most: int | None = None) -> DataFrame:
    """One job with its attachments nested as by :func:`nested_attachments` (empty result = not
    found): all of them, in one row but for a job with more than ``NEST_FEW``, or the
    ``most`` newest.  Both sides are filtered to the id before anything else runs."""
    job = detail_row(by_id(jobs, job_id), catalogs)
    n = to_int_or_none(job_id)
    nested = nested_attachments(by_id(jobs, job_id), attachments.where(F.col("job_id") == F.lit(n)), most)
    return job.join(nested.withColumnRenamed("id", "__id").hint("merge"), F.col("id") == F.col("__id")).drop("__id")


def attachment_summary(jobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Every job with the summary of its attachments (count, newest id, count by
    group, path of the newest).  Partial aggregation keeps a job with very
    many attachments from reaching one task as raw rows."""
    agg = attachments.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_attachments"),
        F.max("id").alias("newest_attachment_id"),
        F.max_by("file_path", F.struct("id", "file_path")).alias("newest_path"),
        *[F.count_if(F.col("group") == F.lit(g)).alias(f"n_{g}") for g in S.ATTACHMENT_GROUPS],
    )
    out = jobs.select("id").join(agg, F.col("id") == agg.job_id, "left").drop("job_id")
    return out.fillna(0, subset=["n_attachments", *[f"n_{g}" for g in S.ATTACHMENT_GROUPS]])


def children_of(children: DataFrame, job_id, fk: str = "job_id") -> DataFrame:
    """Attachments, comments or audit rows of one job, newest (highest id)
    first; the filter on the key reaches the scan."""
    n = to_int_or_none(job_id)
    if n is None:
        raise ValueError(f"invalid id: {job_id!r}")
    return children.where(F.col(fk) == F.lit(n)).orderBy(F.col("id").desc())
