"""Registered queries: scans, filters, search, star join, list, detail, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import exports as X
from ..operators import listing as L
from ..operators.filters import JobFilter
from ..sources.tables import conform
from ..sources.testdata import LIST_AS_OF, REPORT_FROM, REPORT_TO, DriverModel
from ..functions.timefmt import fmt_ts
from .oracle import q
from .registry import register

FILTER_OUT = ["id", "created_at", "status_id", "type_id", "location_id", "priority_id"]
FILTER_SQL_OUT = "id, created_at, status_id, type_id, location_id, priority_id"

# Fixed parameters of the registered filters.
LIST_FILTER = JobFilter(search="job 12", status="3", date_from="1997-01-01", date_to="1999-12-31")
REPORT_FILTER = JobFilter.for_report(search="user1", job_type="2", date_from=REPORT_FROM, date_to=REPORT_TO)
IDS_FILTER = JobFilter(status=2, job_type="3", location="7", priority="1.0")
DEFAULT_RANGE_AS_OF = "1998-06-30"
DETAIL_JOB_ID = 7


@register("catalog_scan", "S1, T6", q("""
SELECT 'status' AS catalog, CAST(ROW_NUMBER() OVER (ORDER BY id) AS INTEGER) AS pos, id, name FROM statuses
UNION ALL SELECT 'type', CAST(ROW_NUMBER() OVER (ORDER BY id) AS INTEGER), id, name FROM types
UNION ALL SELECT 'location', CAST(ROW_NUMBER() OVER (ORDER BY name) AS INTEGER), id, name FROM locations
UNION ALL SELECT 'priority', CAST(ROW_NUMBER() OVER (ORDER BY id) AS INTEGER), id, name FROM priorities
"""))
def catalog_scan(m: DriverModel):
    """The four catalogs in their order, with each row's position in it."""
    return L.catalog_rows(m.catalogs())


@register("jobs_scan", "S3", q(f"SELECT {', '.join(S.JOB_COLUMNS)} FROM jobs"))
def jobs_scan(m: DriverModel):
    """The job fact table in its canonical schema."""
    return m.jobs.select(*S.JOB_COLUMNS)


@register("filter_list", "F1, F3, F6, F7", q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE (description ILIKE '%job 12%' OR provider ILIKE '%job 12%' OR purchase_order ILIKE '%job 12%'
       OR requested_by ILIKE '%job 12%')
  AND status_id = 3
  AND created_at >= TIMESTAMP '1997-01-01 00:00:00' AND created_at <= TIMESTAMP '1999-12-31 23:59:59'
"""))
def filter_list(m: DriverModel):
    return LIST_FILTER.apply(m.jobs).select(*FILTER_OUT)


@register("filter_report", "F2, F4", q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE (description ILIKE '%user1%' OR coalesce(provider, '') ILIKE '%user1%'
       OR coalesce(purchase_order, '') ILIKE '%user1%' OR coalesce(requested_by, '') ILIKE '%user1%'
       OR coalesce(created_by_name, '') ILIKE '%user1%' OR coalesce(created_by_email, '') ILIKE '%user1%'
       OR coalesce(notes, '') ILIKE '%user1%')
  AND type_id = 2
  AND created_at >= TIMESTAMP '{REPORT_FROM} 00:00:00' AND created_at <= TIMESTAMP '{REPORT_TO} 23:59:59'
"""))
def filter_report(m: DriverModel):
    return REPORT_FILTER.apply(m.jobs).select(*FILTER_OUT)


@register("filter_ids", "F6", q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE status_id = 2 AND type_id = 3 AND location_id = 7 AND priority_id = 1
"""))
def filter_ids(m: DriverModel):
    return IDS_FILTER.apply(m.jobs).select(*FILTER_OUT)


@register("filter_date_range", "F7, K9", q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE created_at >= TIMESTAMP '{REPORT_FROM} 00:00:00' AND created_at <= TIMESTAMP '{REPORT_TO} 23:59:59'
"""))
def filter_date_range(m: DriverModel):
    return JobFilter(date_from=REPORT_FROM, date_to=REPORT_TO).apply(m.jobs).select(*FILTER_OUT)


@register("filter_default_range", "F8, F9", q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE created_at >= TIMESTAMP '1998-05-31 00:00:00' AND created_at <= TIMESTAMP '{DEFAULT_RANGE_AS_OF} 23:59:59'
"""))
def filter_default_range(m: DriverModel):
    """No dates given (a malformed one is ignored): the last 30 days to as_of."""
    f = JobFilter.for_report(date_from="1998-13-45").with_default_range(DEFAULT_RANGE_AS_OF)
    return f.apply(m.jobs).select(*FILTER_OUT)


@register("search_4col", "F3", q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE description ILIKE '%customer#0000001%' OR provider ILIKE '%customer#0000001%'
   OR purchase_order ILIKE '%customer#0000001%' OR requested_by ILIKE '%customer#0000001%'
"""))
def search_4col(m: DriverModel):
    return JobFilter(search="  customer#0000001 ").apply(m.jobs).select(*FILTER_OUT)


SEARCH_7COL_SQL = q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE description ILIKE '%user12%' OR coalesce(provider, '') ILIKE '%user12%'
   OR coalesce(purchase_order, '') ILIKE '%user12%' OR coalesce(requested_by, '') ILIKE '%user12%'
   OR coalesce(created_by_name, '') ILIKE '%user12%' OR coalesce(created_by_email, '') ILIKE '%user12%'
   OR coalesce(notes, '') ILIKE '%user12%'
""")


@register("search_7col", "F4", SEARCH_7COL_SQL)
def search_7col(m: DriverModel):
    return JobFilter.for_report(search="user12").apply(m.jobs).select(*FILTER_OUT)


SEARCH_WILDCARDS_SQL = q(f"""
SELECT {FILTER_SQL_OUT} FROM jobs
WHERE regexp_matches(description, '(?is).*ing job [24].0.*')
   OR regexp_matches(coalesce(provider, ''), '(?is).*ing job [24].0.*')
   OR regexp_matches(coalesce(purchase_order, ''), '(?is).*ing job [24].0.*')
   OR regexp_matches(coalesce(requested_by, ''), '(?is).*ing job [24].0.*')
   OR description ILIKE '%oc-1_3%' OR provider ILIKE '%oc-1_3%'
   OR purchase_order ILIKE '%oc-1_3%' OR requested_by ILIKE '%oc-1_3%'
""")


@register("search_wildcards", "F5", SEARCH_WILDCARDS_SQL)
def search_wildcards(m: DriverModel):
    """User text keeps its wildcards: '[24]' is a set and '_' one character."""
    a = JobFilter(search="ING job [24]_0").predicate()
    b = JobFilter(search="oc-1_3").predicate()
    return m.jobs.where(a | b).select(*FILTER_OUT)


@register("star_inner", "J1", q("""
SELECT j.id, s.name AS status, t.name AS job_type, l.name AS location
FROM jobs j JOIN statuses s ON s.id = j.status_id JOIN types t ON t.id = j.type_id
JOIN locations l ON l.id = j.location_id
"""))
def star_inner(m: DriverModel):
    return L.star(m.jobs, m.catalogs(), with_priority=False).select("id", "status", "job_type", "location")


@register("star_left", "J2", q("""
SELECT j.id, j.priority_id, p.name AS priority FROM jobs j LEFT JOIN priorities p ON p.id = j.priority_id
"""))
def star_left(m: DriverModel):
    return L.star(m.jobs, m.catalogs(), inner=False).select("id", "priority_id", "priority")


LIST_ROWS_SQL = """
SELECT id, created_at, provider, description, purchase_order, net_value, repair_date, requested_by,
       closed_at, priority_id, due_date, owner_name, owner_email, status, job_type, location, priority
FROM star
WHERE (description ILIKE '%job 12%' OR provider ILIKE '%job 12%' OR purchase_order ILIKE '%job 12%'
       OR requested_by ILIKE '%job 12%')
  AND status_id = 3
  AND created_at >= TIMESTAMP '1997-01-01 00:00:00' AND created_at <= TIMESTAMP '1999-12-31 23:59:59'
"""


@register("list_rows", "P1, J1, J2", q(LIST_ROWS_SQL))
def list_rows(m: DriverModel):
    return L.list_rows(m.jobs, m.catalogs(), LIST_FILTER)


@register("list_total", "A1, K13", q("""
SELECT COUNT(*) AS total FROM jobs
WHERE (description ILIKE '%job 12%' OR provider ILIKE '%job 12%' OR purchase_order ILIKE '%job 12%'
       OR requested_by ILIKE '%job 12%')
  AND status_id = 3
  AND created_at >= TIMESTAMP '1997-01-01 00:00:00' AND created_at <= TIMESTAMP '1999-12-31 23:59:59'
"""))
def list_total(m: DriverModel):
    return L.list_total(m.jobs, LIST_FILTER)


@register("list_page", "T1, T2, K6", q(f"""
SELECT id, created_at, status, job_type, location, priority,
       GREATEST(0, CAST(FLOOR((epoch(TIMESTAMP '{LIST_AS_OF}') - epoch(created_at)) / 86400) AS BIGINT)) AS days_open
FROM star
ORDER BY created_at DESC, id DESC
LIMIT 50 OFFSET 100
"""))
def list_page(m: DriverModel):
    """Third page of 50 of the whole list, newest first."""
    rows = L.enrich(L.star(m.jobs, m.catalogs()), LIST_AS_OF)
    return L.list_page(rows, page="3", page_size=50).select(
        "id", "created_at", "status", "job_type", "location", "priority", "days_open")


@register("days_open", "P4, K3", q(f"""
SELECT id, GREATEST(0, CAST(FLOOR((epoch(TIMESTAMP '{LIST_AS_OF}') - epoch(created_at)) / 86400) AS BIGINT)) AS days_open
FROM jobs
"""))
def days_open(m: DriverModel):
    return L.enrich(L.star(m.jobs, m.catalogs()), LIST_AS_OF).select("id", "days_open")


@register("overdue_flag", "P5, K1", q(f"""
SELECT id, coalesce(due_date IS NOT NULL AND lower(status) <> 'cerrado'
                    AND CAST(TIMESTAMP '{LIST_AS_OF}' AS DATE) > due_date, false) AS overdue
FROM star
"""))
def overdue_flag(m: DriverModel):
    return L.enrich(L.star(m.jobs, m.catalogs()), LIST_AS_OF).select("id", "overdue")


@register("status_bucket", "P10", q("""
SELECT id, CASE WHEN lower(status) = 'cerrado' THEN 'closed'
                WHEN lower(status) IN ('en curso', 'en_curso') THEN 'in_progress'
                WHEN lower(status) = 'pendiente' THEN 'pending' ELSE 'other' END AS bucket
FROM star
"""))
def status_bucket(m: DriverModel):
    return L.star(m.jobs, m.catalogs(), with_priority=False).select(
        "id", L.status_bucket("status").alias("bucket"))


@register("child_scan", "S4, T5, X4", q("""
SELECT id, job_id, comment, author_name, author_email,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM comments
"""))
def child_scan(m: DriverModel):
    """Comments of every job, newest (highest id) first within the job.
    The global sort is range partitioned, so a job with very many comments
    is split over several tasks."""
    c = m.comments
    return (c.select("id", "job_id", "comment", "author_name", "author_email",
                     fmt_ts("created_at").alias("created_at"))
            .orderBy(F.col("job_id"), F.col("id").desc()))


@register("drift_scan", "S5, M12", q("""
SELECT id, job_id, "group", file_path, CAST(NULL AS VARCHAR) AS original_name,
       CAST(NULL AS TIMESTAMP) AS uploaded_at
FROM attachments
"""))
def drift_scan(m: DriverModel):
    """Attachments written in the older layout (group column named ``tipo``, no
    original name, no upload time) read into the current schema."""
    old = m.attachments.select("id", "job_id", F.col("group").alias("tipo"), "file_path")
    return conform(old, S.ATTACHMENT, aliases={"group": ["tipo_adjunto", "tipo"]})


DETAIL_SQL = f"""
, att AS (
  SELECT job_id, COUNT(*) AS n_attachments, MAX(id) AS newest_attachment_id,
         string_agg(CAST(id AS VARCHAR), ',' ORDER BY id DESC, file_path DESC) AS attachment_ids
  FROM attachments WHERE job_id = {DETAIL_JOB_ID} GROUP BY job_id
)
SELECT s.id, s.created_at, s.provider, s.description, s.status AS status_name, s.job_type AS type_name,
       s.location AS location_name, s.priority AS priority_name,
       strftime(s.created_at, '%Y-%m-%d %H:%M:%S') AS created_at_str,
       strftime(s.closed_at, '%Y-%m-%d %H:%M:%S') AS closed_at_str,
       strftime(s.due_date, '%Y-%m-%d') AS due_date_str,
       coalesce(a.n_attachments, 0) AS n_attachments, a.newest_attachment_id,
       coalesce(a.attachment_ids, '') AS attachment_ids
FROM star s LEFT JOIN att a ON a.job_id = s.id
WHERE s.id = {DETAIL_JOB_ID}
"""


@register("job_detail", "F10, P3, P9, J4", q(DETAIL_SQL))
def job_detail(m: DriverModel):
    """Detail of one job with its attachments nested newest first; the
    registered form shows the nested part as count, newest id and id list."""
    d = L.job_detail(m.jobs, m.catalogs(), m.attachments, DETAIL_JOB_ID)
    job = ["id", "created_at", "provider", "description", "status_name", "type_name",
           "location_name", "priority_name", "created_at_str", "closed_at_str", "due_date_str"]
    ids = F.array_join(F.transform("attachments", lambda a: a["id"].cast("string")), ",")
    parts = d.select(*job, "first", (F.size("attachments") + F.col("more")).alias("n"),
                     F.array_max(F.transform("attachments", lambda a: a["id"])).alias("newest"), F.nullif(ids, F.lit("")).alias("ids"))
    # The pieces of a large list are joined in their order; a job that comes twice keeps its rows.
    copy = F.row_number().over(Window.partitionBy(*job, "first").orderBy("first"))
    pieces = F.sort_array(F.collect_list(F.struct("first", "ids")))
    return parts.withColumn("copy", copy).groupBy(*job, "copy").agg(
        F.sum("n").alias("n_attachments"), F.max("newest").alias("newest_attachment_id"),
        F.array_join(F.transform(pieces, lambda p: p["ids"]), ",").alias("attachment_ids")).drop("copy")


@register("job_with_attachments", "J4", q("""
, agg AS (
  SELECT job_id, COUNT(*) AS n_attachments, MAX(id) AS newest_attachment_id,
         arg_max(file_path, (id, file_path)) AS newest_path,
         COUNT(*) FILTER (WHERE "group" = 'antes') AS n_antes,
         COUNT(*) FILTER (WHERE "group" = 'despues') AS n_despues,
         COUNT(*) FILTER (WHERE "group" = 'evidencia') AS n_evidencia
  FROM attachments GROUP BY job_id
)
SELECT j.id, coalesce(a.n_attachments, 0) AS n_attachments, a.newest_attachment_id, a.newest_path,
       coalesce(a.n_antes, 0) AS n_antes, coalesce(a.n_despues, 0) AS n_despues,
       coalesce(a.n_evidencia, 0) AS n_evidencia
FROM jobs j LEFT JOIN agg a ON a.job_id = j.id
"""))
def job_with_attachments(m: DriverModel):
    return L.attachment_summary(m.jobs, m.attachments)


EXPORT_SQL = f"""
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, status, job_type, location, priority,
       provider, description, purchase_order, net_value, requested_by, repair_date, due_date,
       owner_name, owner_email,
       GREATEST(0, CAST(FLOOR((epoch(TIMESTAMP '{LIST_AS_OF}') - epoch(s.created_at)) / 86400) AS BIGINT)) AS days_open,
       coalesce(due_date IS NOT NULL AND lower(status) <> 'cerrado'
                AND CAST(TIMESTAMP '{LIST_AS_OF}' AS DATE) > due_date, false) AS overdue
FROM star s
WHERE (description ILIKE '%job 12%' OR provider ILIKE '%job 12%' OR purchase_order ILIKE '%job 12%'
       OR requested_by ILIKE '%job 12%')
  AND status_id = 3
  AND s.created_at >= TIMESTAMP '1997-01-01 00:00:00' AND s.created_at <= TIMESTAMP '1999-12-31 23:59:59'
"""


@register("export_rows", "P2, T7, F1", q(EXPORT_SQL))
def export_rows(m: DriverModel):
    return X.export_rows(m.jobs, m.catalogs(), LIST_FILTER, LIST_AS_OF)


@register("export_labelled", "S8, P6, P7, P8", q(f"""
, e AS ({EXPORT_SQL})
SELECT id AS "ID", created_at AS "Fecha creación", status AS "Estado", job_type AS "Tipo",
       location AS "Ubicación", priority AS "Prioridad", provider AS "Proveedor",
       description AS "Descripción", purchase_order AS "OC", net_value AS "Valor neto",
       requested_by AS "Solicitado por", coalesce(strftime(repair_date, '%Y-%m-%d'), '') AS "Fecha reparación",
       coalesce(strftime(due_date, '%Y-%m-%d'), '') AS "Fecha objetivo", owner_name AS "Resp. nombre",
       owner_email AS "Resp. correo", days_open AS "Días abierto",
       CASE WHEN overdue THEN 'SI' ELSE 'NO' END AS "Atrasado"
FROM e
"""))
def export_labelled(m: DriverModel):
    return X.labelled(X.export_rows(m.jobs, m.catalogs(), LIST_FILTER, LIST_AS_OF, ordered=False))


def _csv_sql(expr: str) -> str:
    return (f"CASE WHEN ({expr}) IS NULL THEN '' "
            f"WHEN regexp_matches(CAST({expr} AS VARCHAR), '[\";\\n\\r]') "
            f"THEN '\"' || replace(CAST({expr} AS VARCHAR), '\"', '\"\"') || '\"' "
            f"ELSE CAST({expr} AS VARCHAR) END")


_CSV_COLS = [("id", "id"), ("created_at", "created_at"), ("status", "status"), ("job_type", "job_type"),
             ("location", "location"), ("priority", "priority"), ("provider", "provider"),
             ("description", "description"), ("purchase_order", "purchase_order"),
             ("net_value", "net_value"), ("requested_by", "requested_by"),
             ("repair_date", "strftime(repair_date, '%Y-%m-%d')"),
             ("due_date", "strftime(due_date, '%Y-%m-%d')"), ("owner_name", "owner_name"),
             ("owner_email", "owner_email"), ("days_open", "days_open"), ("overdue", "overdue")]


@register("export_csv_rows", "S7, X26, K12", q(f"""
, e AS ({EXPORT_SQL})
SELECT id, {" || ';' || ".join(_csv_sql(expr) for _, expr in _CSV_COLS)} AS line
FROM e
"""))
def export_csv_rows(m: DriverModel):
    """Each export row as its CSV line: ';' separated, quoted only when needed."""
    return X.csv_lines(X.export_rows(m.jobs, m.catalogs(), LIST_FILTER, LIST_AS_OF, ordered=False))


@register("job_attachments_nested", "J4", q("""
SELECT j.id, a.pos, a.id AS attachment_id, a."group", a.file_path
FROM jobs j JOIN (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY id DESC, file_path DESC, "group" DESC, original_name DESC) - 1 AS INTEGER) AS pos
  FROM attachments) a ON a.job_id = j.id
"""))
def job_attachments_nested(m: DriverModel):
    """All attachments nested in every job, unfolded again with their place."""
    nested = L.nested_attachments(m.jobs, m.attachments)
    return nested.select("id", "first", F.posexplode("attachments").alias("pos", "a")).select(
        "id", (F.col("first") + F.col("pos")).cast("int").alias("pos"), F.col("a.id").alias("attachment_id"), F.col("a.group").alias("group"), F.col("a.file_path").alias("file_path"))
