"""Registered queries over tables that they store first: search by postings, pages by rank,
uploads as real files, files of two generations; and grouping by a collation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import attachments as A
from ..operators import listing as L
from ..operators import reports as R
from ..operators import rank_pages, search_index
from ..sources.tables import merged_table
from ..sources.testdata import DriverModel
from .oracle import q
from .q_listing import FILTER_OUT, SEARCH_7COL_SQL, SEARCH_WILDCARDS_SQL
from .q_sinks import _fresh
from .registry import register

LATE_PAGE, PAGE_SIZE, ROWS_PER_RANGE = 45, 20, 300
MIGRATED = "1996-01-01"
NEST = 3
UPLOAD_LIMIT = 130


def _indexed(m: DriverModel) -> str:
    path = _fresh(m, "search")
    search_index.write_search_index(m.jobs.select(*S.JOB_COLUMNS), path, list(S.REPORT_SEARCH_COLS))
    return path


@register("search_indexed", "F4, F3", SEARCH_7COL_SQL)
def search_indexed(m: DriverModel):
    """The search in seven columns by trigram postings of the stored jobs, every candidate verified."""
    return search_index.search_stored(m.spark, _indexed(m), "user12", list(S.REPORT_SEARCH_COLS)).select(*FILTER_OUT)


@register("search_indexed_wildcards", "F5", SEARCH_WILDCARDS_SQL)
def search_indexed_wildcards(m: DriverModel):
    """Patterns with a set and one-character wildcards by the same postings: only the runs between them are looked up."""
    return search_index.search_any(m.spark, _indexed(m), ["ING job [24]_0", "oc-1_3"], list(S.LIST_SEARCH_COLS), null_safe=False).select(*FILTER_OUT)


@register("page_by_rank", "T2", q(f"""
SELECT id, created_at, status, job_type, location, priority FROM star
ORDER BY created_at DESC, id DESC LIMIT {PAGE_SIZE} OFFSET {(LATE_PAGE - 1) * PAGE_SIZE}
"""))
def page_by_rank(m: DriverModel):
    """A page far down the whole list: only the ranges with its ranks are read."""
    path = _fresh(m, "ranked")
    rank_pages.write_ranked(L.star(m.jobs, m.catalogs()).select("id", "created_at", "status", "job_type", "location", "priority"), path, ROWS_PER_RANGE)
    return rank_pages.page_by_rank(m.spark, path, LATE_PAGE, PAGE_SIZE)


@register("job_attachments_bounded", "J4", q(f"""
, ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY id DESC, file_path DESC, "group" DESC, original_name DESC) AS rn FROM attachments
), per AS (
  SELECT job_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= {NEST}) AS newest, COUNT(*) AS n FROM ranked GROUP BY job_id
)
SELECT j.id, coalesce(newest, '') AS newest, CAST(greatest(coalesce(n, 0) - {NEST}, 0) AS BIGINT) AS more FROM jobs j LEFT JOIN per ON per.job_id = j.id
"""))
def job_attachments_bounded(m: DriverModel):
    """The three newest attachments nested in every job, and how many more it has (the bound is the feature)."""
    nested = L.nested_attachments(m.jobs, m.attachments, most=NEST)
    return nested.select("id", F.array_join(F.transform("attachments", lambda a: a["id"].cast("string")), ",").alias("newest"), "more")


_KIND = "CASE WHEN s_suppkey % 11 = 0 THEN 'application/pdf' WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'image/jpeg' WHEN s_suppkey % 3 = 1 THEN 'image/png' ELSE 'image/webp' END"
_HEAD_BYTES = {"image/jpeg": 3, "image/png": 8, "image/webp": 12, "application/pdf": 5}


@register("uploads_scanned", "S11, W3", q(f"""
, f AS (
  SELECT s_suppkey // 4 AS job_id, CASE s_suppkey % 3 WHEN 0 THEN 'antes' WHEN 1 THEN 'despues' ELSE 'evidencia' END AS "group", {_KIND} AS kind,
         {_KIND.replace(" NULL", " 4").replace("'application/pdf'", "5").replace("'image/jpeg'", "3").replace("'image/png'", "8").replace("'image/webp'", "12")}
           + length(s_name) + s_suppkey % 120 + 1 AS size_bytes
  FROM supplier
), g AS (
  SELECT job_id, "group", size_bytes, CASE WHEN size_bytes <= {UPLOAD_LIMIT} THEN kind END AS mime_type FROM f
), v AS (
  SELECT job_id, concat_ws(',',
    {", ".join(f"""CASE WHEN COUNT(*) FILTER (WHERE "group" = '{g}') > {n} THEN 'count:{g}' END""" for g, n in S.ATTACHMENT_GROUP_LIMITS.items())},
    CASE WHEN bool_or(coalesce(mime_type NOT IN ({", ".join(f"'{x}'" for x in S.ALLOWED_MIME)}), true)) THEN 'mime' END,
    CASE WHEN bool_or(size_bytes > {UPLOAD_LIMIT}) THEN 'size' END) AS reason FROM g GROUP BY job_id
)
SELECT g.job_id, g."group", g.mime_type, CAST(g.size_bytes AS BIGINT) AS size_bytes, v.reason, v.reason = '' AS accepted FROM g JOIN v ON v.job_id = g.job_id
"""))
def uploads_scanned(m: DriverModel):
    """A file for each supplier, written to disk with the first bytes of its type, then read as uploads:
    the type comes from these bytes, the bytes of files over the limit are not read."""
    heads = {"image/jpeg": A.JPEG_HEAD, "image/png": A.PNG_HEAD, "image/webp": "524946460000000057454250", "application/pdf": A.PDF_HEAD}
    kind = F.expr(_KIND)
    head = F.lit("48656C70")
    for mime, first in heads.items():
        head = F.when(kind == mime, first).otherwise(head)
    k = F.col("s_suppkey")
    fill = F.expr("repeat('x', int(s_suppkey % 120))")
    files = m.read("supplier", ["s_suppkey", "s_name"]).select(
        F.floor(k / 4).cast("bigint").alias("job_id"), F.when(k % 3 == 0, "antes").when(k % 3 == 1, "despues").otherwise("evidencia").alias("group"),
        F.concat(F.unhex(head).cast("string"), F.col("s_name"), fill).alias("value"))
    path = _fresh(m, "uploads")
    # A file costs far more than its bytes, by which Spark would put all of them into one task: the number of tasks is given.
    tasks = max(int(m.spark.conf.get("spark.sql.shuffle.partitions")), m.spark.sparkContext.defaultParallelism)
    files.repartition(tasks, "job_id").write.option("maxRecordsPerFile", 1).partitionBy("job_id", "group").text(path)
    found = A.scan_uploads(m.spark, path, A.COLUMN_PATH, "part-*", UPLOAD_LIMIT)
    return A.check_uploads(found, upload_col="job_id", max_bytes=UPLOAD_LIMIT).select("job_id", "group", "mime_type", "size_bytes", "reason", "accepted")


@register("drift_merged", "S5, M12", q(f"""
SELECT id, created_at, provider, requested_by,
       CASE WHEN created_at >= TIMESTAMP '{MIGRATED} 00:00:00' THEN priority_id END AS priority_id,
       CASE WHEN created_at >= TIMESTAMP '{MIGRATED} 00:00:00' THEN due_date END AS due_date,
       CASE WHEN created_at >= TIMESTAMP '{MIGRATED} 00:00:00' THEN owner_name END AS owner_name
FROM jobs
"""))
def drift_merged(m: DriverModel):
    """Jobs written before a migration (an older column name, no priority, due date
    and owner) and after it, read as one table in one scan."""
    path = _fresh(m, "generations")
    columns = ["id", "created_at", "provider", "requested_by", "priority_id", "due_date", "owner_name"]
    new = m.jobs.select(*columns)
    cut = F.lit(f"{MIGRATED} 00:00:00").cast("timestamp_ntz")
    new.where(F.col("created_at") < cut).drop("priority_id", "due_date", "owner_name").withColumnRenamed("requested_by", "solicitante").write.parquet(f"{path}/old")
    new.where(F.col("created_at") >= cut).write.parquet(f"{path}/new")
    return merged_table(m.spark, [f"{path}/old", f"{path}/new"], new.schema, {"requested_by": ["solicitante"]})


@register("top_providers_ci", "A9", q("""
, named AS (
  SELECT coalesce(nullif(trim(CASE id % 3 WHEN 0 THEN upper(provider) WHEN 1 THEN lower(provider) ELSE provider END), ''), '—') AS name, net_value FROM jobs
)
SELECT min(name) AS provider, COUNT(*) AS total, CAST(SUM(coalesce(net_value, 0)) AS DECIMAL(38,2)) AS amount
FROM named GROUP BY lower(name) ORDER BY amount DESC, total DESC, provider LIMIT 10
"""))
def top_providers_ci(m: DriverModel):
    """Top providers where names written in different case are one."""
    spelt = F.when(F.col("id") % 3 == 0, F.upper("provider")).when(F.col("id") % 3 == 1, F.lower("provider")).otherwise(F.col("provider"))
    return R.top_providers(m.jobs.withColumn("provider", spelt), collation="UNICODE_CI")
