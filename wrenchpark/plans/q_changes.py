"""Registered queries: updates, status changes, deletes, cascades, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as AU
from ..operators import changes as C
from ..operators import ingest as I
from ..sources.testdata import LIST_AS_OF, DriverModel
from .oracle import q
from .q_sinks import _fresh
from .registry import register

UPD_COLS = C.UPDATE_COLUMNS


def _updates(m: DriverModel):
    """Update-mode records aimed at job (record_id div 2) * 3: two updates per
    target (the later wins), targets past the last job are not found."""
    return _aimed(I.accepted(I.validate(m.incoming, mode="update")))


def _aimed(updates: DataFrame) -> DataFrame:
    return updates.withColumn("target_id", F.expr("record_id div 2") * 3).withColumn("seq", F.col("record_id"))


_UPD_SQL = """
, upd AS (
  SELECT (record_id // 2) * 3 AS target_id, record_id AS seq,
         CASE WHEN length(trim(created_by_name)) > 0 THEN trim(created_by_name) END AS created_by_name,
         v_created_by_email AS created_by_email,
         CASE WHEN length(trim(provider)) > 0 THEN trim(provider) END AS provider,
         v_description AS description, v_location_id AS location_id,
         CASE WHEN length(trim(purchase_order)) > 0 THEN trim(purchase_order) END AS purchase_order,
         v_net_value AS net_value, v_type_id AS type_id, v_status_id AS status_id,
         v_repair_date AS repair_date, CAST(NULL AS VARCHAR) AS requested_by, CAST(NULL AS VARCHAR) AS notes,
         v_priority_id AS priority_id, v_due_date AS due_date, CAST(NULL AS VARCHAR) AS owner_name,
         v_owner_email AS owner_email
  FROM checked WHERE update_error_fields = ''
), known_upd AS (
  SELECT *, concat_ws(',', CASE WHEN status_id NOT IN (SELECT id FROM statuses) THEN 'fk:status' END,
                           CASE WHEN type_id NOT IN (SELECT id FROM types) THEN 'fk:type' END,
                           CASE WHEN location_id NOT IN (SELECT id FROM locations) THEN 'fk:location' END,
                           CASE WHEN priority_id NOT IN (SELECT id FROM priorities) THEN 'fk:priority' END) AS reason
  FROM upd
), last_upd AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) AS rn FROM known_upd WHERE reason = '') WHERE rn = 1
)
"""


@register("apply_updates", "M3, W4, K5", q(_UPD_SQL + """
SELECT j.id, j.created_at, j.closed_at, """ + ",\n       ".join(
    f"CASE WHEN u.target_id IS NOT NULL THEN u.{c} ELSE j.{c} END AS {c}" for c in UPD_COLS) + """
FROM jobs j LEFT JOIN last_upd u ON u.target_id = j.id
"""))
def apply_updates(m: DriverModel):
    """The job table after a batch of full updates (last update per id wins;
    created_at and closed_at untouched)."""
    snap, _ = C.apply_updates(m.jobs, _updates(m), catalogs=m.catalogs())
    return snap.select("id", "created_at", "closed_at", *UPD_COLS)


@register("update_not_found", "M3", q(_UPD_SQL + """
SELECT target_id, seq FROM upd WHERE target_id NOT IN (SELECT id FROM jobs)
"""))
def update_not_found(m: DriverModel):
    _, nf = C.apply_updates(m.jobs, _updates(m))
    return nf.select("target_id", "seq")


@register("update_rejects", "M3, K14", q(_UPD_SQL + """
SELECT target_id, seq, reason FROM known_upd WHERE reason <> '' AND target_id IN (SELECT id FROM jobs)
"""))
def update_rejects(m: DriverModel):
    """Updates of existing jobs that name a missing catalog row."""
    return C.update_rejects(m.jobs, _updates(m), m.catalogs()).select("target_id", "seq", "reason")


_VALID_SQL = """
, valid AS (
  SELECT c.*, lower(s.name) = 'cerrado' AS closes
  FROM status_changes c JOIN statuses s ON s.id = c.status_id
  WHERE coalesce(c.status_id, 0) <> 0 AND c.job_id IN (SELECT id FROM jobs)
), hist AS (
  SELECT v.job_id, v.seq, v.ts,
         coalesce(LAG(v.status_id) OVER (PARTITION BY v.job_id ORDER BY v.ts, v.seq), j.status_id) AS from_status,
         v.status_id AS to_status, v.closes AS closed
  FROM valid v JOIN jobs j ON j.id = v.job_id
)
"""


@register("apply_changes", "M4, W4", q(_VALID_SQL + """
, last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM valid)
  WHERE rn = 1
)
SELECT j.id, CASE WHEN l.job_id IS NOT NULL THEN l.status_id ELSE j.status_id END AS status_id,
       CASE WHEN l.job_id IS NOT NULL THEN CASE WHEN l.closes THEN l.ts END ELSE j.closed_at END AS closed_at
FROM jobs j LEFT JOIN last l ON l.job_id = j.id
"""))
def apply_changes(m: DriverModel):
    """Job statuses and closing times after the batch of status changes."""
    snap = C.apply_status_changes(m.jobs, m.status_changes, m.statuses)
    return snap.select("id", "status_id", "closed_at")


@register("change_rejects", "K14, M4", q("""
SELECT c.job_id, c.seq, CASE WHEN s.id IS NULL THEN 'fk:estado' ELSE 'not_found' END AS reason
FROM status_changes c LEFT JOIN statuses s ON s.id = c.status_id
WHERE s.id IS NULL OR c.job_id NOT IN (SELECT id FROM jobs)
"""))
def change_rejects(m: DriverModel):
    _, rej = C.valid_status_changes(m.jobs, m.status_changes, m.statuses)
    return rej.select("job_id", "seq", "reason")


@register("status_history", "M4", q(_VALID_SQL + "SELECT * FROM hist"))
def status_history(m: DriverModel):
    """Every applied change with the status it replaced."""
    return C.status_history(m.jobs, m.status_changes, m.statuses)


@register("audit_rows", "M9, X17", q(_VALID_SQL + """
SELECT job_id, seq, 'ESTADO_CAMBIADO' AS action,
       to_json({'from': from_status, 'to': to_status, 'cerrado': closed}) AS detail, ts AS logged_at
FROM hist
"""))
def audit_rows(m: DriverModel):
    """Audit rows of the status-change batch with their JSON detail."""
    return AU.audit_from_history(C.status_history(m.jobs, m.status_changes, m.statuses))


_DELETE_SQL = """
, del AS (
  SELECT conv_id * 1000 + turn AS id FROM conversations WHERE role = 'assistant' AND turn >= 5
  UNION ALL SELECT conv_id * 1000 + 9 FROM conversations WHERE turn = 0
)
"""


def _delete_ids(m: DriverModel):
    conv = m.read("conversations", ["conv_id", "turn", "role"])
    a = conv.where((F.col("role") == "assistant") & (F.col("turn") >= 5)).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    b = conv.where(F.col("turn") == 0).select((F.col("conv_id") * 1000 + 9).alias("id"))
    return a.unionByName(b)


@register("delete_rows", "M6, M7", q(_DELETE_SQL + """
SELECT id, job_id FROM comments WHERE id NOT IN (SELECT id FROM del)
"""))
def delete_rows(m: DriverModel):
    """Comments left after a batch of deletions by id."""
    left, _ = C.delete_rows(m.comments, _delete_ids(m))
    return left.select("id", "job_id")


@register("delete_not_found", "M6, M7", q(_DELETE_SQL + """
SELECT DISTINCT id FROM del WHERE id NOT IN (SELECT id FROM comments)
"""))
def delete_not_found(m: DriverModel):
    _, nf = C.delete_rows(m.comments, _delete_ids(m))
    return nf


@register("attachment_delete", "M7", q("""
SELECT id, job_id FROM attachments WHERE id NOT IN (SELECT id FROM attachments WHERE "group" = 'antes' AND size_bytes > 4000000)
"""))
def attachment_delete(m: DriverModel):
    """Attachments left after deleting the large ones of one group by id."""
    gone = m.attachments.where((F.col("group") == "antes") & (F.col("size_bytes") > 4000000)).select("id")
    left, _ = C.delete_rows(m.attachments, gone)
    return left.select("id", "job_id")


@register("cascade_delete", "J6, M8", q("""
, gone AS (SELECT id FROM jobs WHERE status_id = 3 AND created_at < TIMESTAMP '1996-01-01 00:00:00')
SELECT 'attachments' AS child, id, job_id FROM attachments WHERE job_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'comments', id, job_id FROM comments WHERE job_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'audit', id, job_id FROM audit WHERE job_id NOT IN (SELECT id FROM gone)
"""))
def cascade_delete(m: DriverModel):
    """Children left after purging closed jobs created before 1996."""
    gone = m.jobs.where((F.col("status_id") == 3) & (F.col("created_at") < F.lit("1996-01-01 00:00:00")
                                                       .cast("timestamp_ntz")))
    left = C.cascade_delete({"attachments": m.attachments, "comments": m.comments, "audit": m.audit}, gone)
    out = None
    for name, df in left.items():
        part = df.select(F.lit(name).alias("child"), "id", "job_id")
        out = part if out is None else out.unionByName(part)
    return out


@register("audit_parsed", "X18, S4, T5", q("""
SELECT id, job_id, action, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS logged_at,
       CASE WHEN json_valid(detail) THEN CAST(json_extract(detail, '$.k') AS INTEGER) END AS detail_k
FROM audit
"""))
def audit_parsed(m: DriverModel):
    """Audit log read back with the JSON detail parsed (a bad document is NULL)."""
    p = AU.parsed(m.audit)
    return p.select("id", "job_id", "action", "logged_at",
                    F.try_variant_get("detail_json", "$.k", "int").alias("detail_k"))


_ACTIONS_SQL = _UPD_SQL + _VALID_SQL + _DELETE_SQL + """
, created AS (
  SELECT (SELECT MAX(id) FROM jobs) + ROW_NUMBER() OVER (ORDER BY record_id) AS job_id, v_type_id, v_location_id, v_priority_id, v_due_date
  FROM checked WHERE error_fields = '' AND v_type_id IN (SELECT id FROM types) AND v_location_id IN (SELECT id FROM locations)
    AND (v_priority_id IS NULL OR v_priority_id IN (SELECT id FROM priorities))
), actions AS (
  SELECT job_id, 'CREADO' AS action, to_json({'tipo_id': v_type_id, 'ubicacion_id': v_location_id, 'prioridad_id': v_priority_id,
                                             'fecha_objetivo': strftime(v_due_date, '%Y-%m-%d')}) AS detail FROM created
  UNION ALL SELECT job_id, 'ADJUNTO_SUBIDO', to_json({'count': COUNT(*)}) FROM attachments
            WHERE mime_type <> 'application/pdf' GROUP BY job_id
  UNION ALL SELECT target_id, 'EDITADO', to_json({'descripcion': substr(description, 1, 200)}) FROM known_upd
            WHERE reason = '' AND target_id IN (SELECT id FROM jobs)
  UNION ALL SELECT job_id, 'ESTADO_CAMBIADO', to_json({'from': from_status, 'to': to_status, 'cerrado': closed}) FROM hist
  UNION ALL SELECT job_id, 'COMENTARIO_AGREGADO', to_json({'comentario': substr(comment, 1, 200)}) FROM comments
  UNION ALL SELECT job_id, 'COMENTARIO_ELIMINADO', to_json({'comentario_id': id}) FROM comments WHERE id IN (SELECT id FROM del)
  UNION ALL SELECT job_id, 'ADJUNTO_ELIMINADO', to_json({'adjunto_id': id}) FROM attachments WHERE "group" = 'antes' AND size_bytes > 4000000
)
SELECT job_id, action, CAST(detail AS VARCHAR) AS detail, 'sistema' AS actor_name, '10.0.' || CAST(job_id % 256 AS VARCHAR) || '.1' AS ip,
       substr(repeat('agente ', 50), 1, 250) AS user_agent
FROM actions
"""


@register("audit_actions", "M9, X17, X19, X20", q(_ACTIONS_SQL))
def audit_actions(m: DriverModel):
    """Audit rows of all seven actions with actor, first forwarded address and cut agent.

    The records are validated once, and what the actions need of the jobs is derived once: both are
    written and read by the parts that use them."""
    def written(df: DataFrame, name: str) -> DataFrame:
        path = _fresh(m, name)
        df.write.parquet(path)
        return m.spark.read.schema(df.schema).parquet(path)

    records = written(I.validate(m.incoming), "validated")
    jobs = written(m.jobs.select("id", "status_id"), "job-keys")
    new = I.create_jobs(I.accepted(records), jobs, m.statuses, LIST_AS_OF, order_by=["record_id"], catalogs=m.catalogs())
    known, _ = I.split_known(_aimed(I.accepted_updates(records)), m.catalogs())
    edited = known.join(jobs.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    large = m.attachments.where((F.col("group") == "antes") & (F.col("size_bytes") > 4000000))
    parts = [AU.audit_created(new), AU.audit_uploaded(m.attachments.where(F.col("mime_type") != "application/pdf")), AU.audit_edited(edited),
             AU.audit_from_history(C.status_history(jobs, m.status_changes, m.statuses)), AU.audit_from_comments(m.comments),
             AU.audit_deleted(m.comments.join(_delete_ids(m).distinct(), "id", "left_semi"), "comment"), AU.audit_deleted(large, "attachment")]
    rows = reduce(lambda a, b: a.unionByName(b), [p.select(F.col("job_id").cast("long").alias("job_id"), "action", "detail") for p in parts])
    rows = rows.withColumn("forwarded", F.concat(F.lit(" 10.0."), (F.col("job_id") % 256).cast("string"), F.lit(".1 , 172.16.0.1")))
    rows = rows.withColumn("agent", F.repeat(F.lit("agente "), 50))
    out = AU.with_request(rows, forwarded_for="forwarded", user_agent="agent", actor_name="sistema")
    return out.select("job_id", "action", "detail", "actor_name", "ip", "user_agent")
