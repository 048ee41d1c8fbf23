"""Registered queries: validation, creation, comments, references, contracts,
seeds and attachment checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import attachments as A
from ..operators import ingest as I
from ..sources.testdata import LIST_AS_OF, DriverModel
from .oracle import q
from .registry import register

_ALLOWED = ", ".join(f"'{m}'" for m in S.ALLOWED_MIME)
_EXTENSIONS = " ".join(f"WHEN '{m}' THEN '{e}'" for m, e in S.ALLOWED_MIME.items())
ACCEPTED_OUT = ["record_id", "description", "location_id", "type_id", "status_id", "net_value",
                "created_by_email", "repair_date", "priority_id", "due_date", "owner_email"]


@register("validate_accepted", "M1, X10-X16, K8, K10", q("""
SELECT record_id, v_description AS description, v_location_id AS location_id, v_type_id AS type_id,
       v_status_id AS status_id, v_net_value AS net_value, v_created_by_email AS created_by_email,
       v_repair_date AS repair_date, v_priority_id AS priority_id, v_due_date AS due_date,
       v_owner_email AS owner_email
FROM checked WHERE error_fields = ''
"""))
def validate_accepted(m: DriverModel):
    return I.accepted(I.validate(m.incoming)).select(*ACCEPTED_OUT)


@register("validate_rejected", "M1", q("""
SELECT record_id, error_fields FROM checked WHERE error_fields <> ''
"""))
def validate_rejected(m: DriverModel):
    return I.rejected(I.validate(m.incoming)).select("record_id", I.error_fields().alias("error_fields"))


@register("create_jobs", "M2, J8, K7", q(f"""
SELECT (SELECT MAX(id) FROM jobs) + ROW_NUMBER() OVER (ORDER BY record_id) AS id, record_id,
       CAST(1 AS INTEGER) AS status_id, TIMESTAMP '{LIST_AS_OF}' AS created_at,
       created_by_name, v_created_by_email AS created_by_email, v_description AS description,
       v_location_id AS location_id, v_type_id AS type_id
FROM checked WHERE error_fields = '' AND v_type_id IN (SELECT id FROM types) AND v_location_id IN (SELECT id FROM locations)
  AND (v_priority_id IS NULL OR v_priority_id IN (SELECT id FROM priorities))
"""))
def create_jobs(m: DriverModel):
    """Accepted records become jobs numbered above the current maximum id."""
    valid = I.accepted(I.validate(m.incoming))
    new = I.create_jobs(valid, m.jobs, m.statuses, LIST_AS_OF, order_by=["record_id"], catalogs=m.catalogs())
    return new.select("id", "record_id", "status_id", "created_at", "created_by_name", "created_by_email",
                      "description", "location_id", "type_id")


@register("create_rejects", "M2, K14", q("""
SELECT record_id, reason FROM (
  SELECT record_id, concat_ws(',', CASE WHEN v_type_id NOT IN (SELECT id FROM types) THEN 'fk:type' END,
                                   CASE WHEN v_location_id NOT IN (SELECT id FROM locations) THEN 'fk:location' END,
                                   CASE WHEN v_priority_id NOT IN (SELECT id FROM priorities) THEN 'fk:priority' END) AS reason
  FROM checked WHERE error_fields = '')
WHERE reason <> ''
"""))
def create_rejects(m: DriverModel):
    """Accepted records that name a missing type, location or priority."""
    _, refused = I.split_known(I.accepted(I.validate(m.incoming)), m.catalogs(), I.CREATE_FK)
    return refused.select("record_id", "reason")


_COMMENTS_SQL = """
, ic AS (
  SELECT conv_id * 1000 + turn AS comment_seq, conv_id * 211 + turn AS job_id,
         CASE WHEN turn = 3 THEN '   ' ELSE text END AS raw
  FROM conversations
), ct AS (
  SELECT comment_seq, job_id,
         CASE WHEN length(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) > 0
              THEN regexp_replace(raw, '^\\s+|\\s+$', '', 'g') END AS comment
  FROM ic
)
"""


@register("comments_accepted", "M5, F11, J5, X10, P11", q(_COMMENTS_SQL + """
SELECT comment_seq, job_id, comment, substr(comment, 1, 200) AS preview
FROM ct WHERE comment IS NOT NULL AND job_id IN (SELECT id FROM jobs)
"""))
def comments_accepted(m: DriverModel):
    acc, _ = I.comments_split(m.incoming_comments, m.jobs)
    return acc.select("comment_seq", "job_id", "comment", "preview")


@register("comments_rejected", "M5, J5", q(_COMMENTS_SQL + """
SELECT comment_seq, job_id, CASE WHEN comment IS NULL THEN 'empty' ELSE 'not_found' END AS reason
FROM ct WHERE comment IS NULL OR job_id NOT IN (SELECT id FROM jobs)
"""))
def comments_rejected(m: DriverModel):
    _, rej = I.comments_split(m.incoming_comments, m.jobs)
    return rej.select("comment_seq", "job_id", "reason")


@register("fk_violations", "J7, K14", q("""
, acc AS (SELECT record_id AS id, v_status_id AS status_id, v_type_id AS type_id,
                 v_location_id AS location_id, v_priority_id AS priority_id
          FROM checked WHERE error_fields = '')
SELECT id, 'fk:status' AS fk, status_id AS value FROM acc WHERE status_id IS NOT NULL AND status_id NOT IN (SELECT id FROM statuses)
UNION ALL SELECT id, 'fk:type', type_id FROM acc WHERE type_id IS NOT NULL AND type_id NOT IN (SELECT id FROM types)
UNION ALL SELECT id, 'fk:location', location_id FROM acc WHERE location_id IS NOT NULL AND location_id NOT IN (SELECT id FROM locations)
UNION ALL SELECT id, 'fk:priority', priority_id FROM acc WHERE priority_id IS NOT NULL AND priority_id NOT IN (SELECT id FROM priorities)
"""))
def fk_violations(m: DriverModel):
    """Accepted records whose catalog ids do not exist."""
    acc = I.accepted(I.validate(m.incoming)).withColumnRenamed("record_id", "rid")
    return I.fk_violations(acc, m.catalogs(), id_col="rid")


@register("contract_violations", "M13, K4", q("""
SELECT 'not_null' AS rule, 'description' AS "column", id FROM jobs WHERE description IS NULL
UNION ALL SELECT 'not_null', 'created_at', id FROM jobs WHERE created_at IS NULL
UNION ALL SELECT 'not_null', 'location_id', id FROM jobs WHERE location_id IS NULL
UNION ALL SELECT 'not_null', 'type_id', id FROM jobs WHERE type_id IS NULL
UNION ALL SELECT 'not_null', 'status_id', id FROM jobs WHERE status_id IS NULL
UNION ALL SELECT 'max_length', 'created_by_email', id FROM jobs WHERE length(created_by_email) > 150
UNION ALL SELECT 'max_length', 'requested_by', id FROM jobs WHERE length(requested_by) > 100
UNION ALL SELECT 'max_length', 'owner_name', id FROM jobs WHERE length(owner_name) > 100
UNION ALL SELECT 'max_length', 'owner_email', id FROM jobs WHERE length(owner_email) > 150
UNION ALL SELECT 'foreign_key', 'status', id FROM jobs WHERE status_id NOT IN (SELECT id FROM statuses)
UNION ALL SELECT 'foreign_key', 'type', id FROM jobs WHERE type_id NOT IN (SELECT id FROM types)
UNION ALL SELECT 'unique', 'status.name', MIN(id) FROM statuses GROUP BY lower(name) HAVING COUNT(*) > 1
UNION ALL SELECT 'unique', 'type.name', MIN(id) FROM types GROUP BY lower(name) HAVING COUNT(*) > 1
UNION ALL SELECT 'unique', 'location.name', MIN(id) FROM locations GROUP BY lower(name) HAVING COUNT(*) > 1
UNION ALL SELECT 'unique', 'priority.name', MIN(id) FROM priorities GROUP BY lower(name) HAVING COUNT(*) > 1
UNION ALL SELECT 'max_length', 'provider', id FROM jobs WHERE length(provider) > 150
UNION ALL SELECT 'max_length', 'purchase_order', id FROM jobs WHERE length(purchase_order) > 50
UNION ALL SELECT 'max_length', 'created_by_name', id FROM jobs WHERE length(created_by_name) > 100
UNION ALL SELECT 'unique', 'id', id FROM jobs GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT 'foreign_key', 'location', id FROM jobs WHERE location_id NOT IN (SELECT id FROM locations)
UNION ALL SELECT 'foreign_key', 'priority', id FROM jobs WHERE priority_id IS NOT NULL AND priority_id NOT IN (SELECT id FROM priorities)
UNION ALL SELECT 'closed_without_time', 'closed_at', j.id FROM jobs j JOIN statuses s ON s.id = j.status_id
          WHERE j.closed_at IS NULL AND lower(s.name) = 'cerrado'
"""))
def contract_violations(m: DriverModel):
    return I.contract_violations(m.jobs, m.catalogs())


@register("status_by_name", "J8, X1", q("""
SELECT e.event_id,
       CASE e.event_type WHEN 'view' THEN 'PENDIENTE' WHEN 'click' THEN 'en curso' WHEN 'purchase' THEN 'Cerrado'
                         WHEN 'signup' THEN 'En Espera' ELSE 'Cancelado' END AS status_text,
       s.id AS status_id
FROM events e LEFT JOIN statuses s ON lower(s.name) = lower(
       CASE e.event_type WHEN 'view' THEN 'PENDIENTE' WHEN 'click' THEN 'en curso' WHEN 'purchase' THEN 'Cerrado'
                         WHEN 'signup' THEN 'En Espera' ELSE 'Cancelado' END)
"""))
def status_by_name(m: DriverModel):
    """Status names typed in any case, looked up to ids (unknown gives NULL)."""
    ev = m.read("events", ["event_id", "event_type"])
    text = (F.when(F.col("event_type") == "view", "PENDIENTE").when(F.col("event_type") == "click", "en curso")
            .when(F.col("event_type") == "purchase", "Cerrado").when(F.col("event_type") == "signup", "En Espera")
            .otherwise("Cancelado"))
    names = ev.select("event_id", text.alias("status_text"))
    return I.lookup_id(names, "status_text", m.statuses, out="status_id")


@register("seed_missing", "M11", q("""
, existing AS (SELECT DISTINCT s.id, s.name FROM jobs j JOIN statuses s ON s.id = j.status_id)
SELECT 'status' AS catalog,
       CAST((SELECT MAX(id) FROM existing) + ROW_NUMBER() OVER (ORDER BY 1) AS INTEGER) AS id, 'En espera' AS name
WHERE NOT EXISTS (SELECT 1 FROM existing WHERE lower(name) = 'en espera')
"""))
def seed_missing(m: DriverModel):
    """The status catalog as the jobs use it, completed by the migration's named
    status when absent (case-insensitive), numbered above the current ids."""
    used = m.jobs.select("status_id").distinct()
    existing = used.join(m.statuses.for_join(), used.status_id == F.col("id")).select("id", "name")
    return I.seed_missing(existing, [(4, "En espera")], only_if_empty=False, catalog_name="status")


@register("attachment_check", "M10, W3, X23, X24, S11", q(f"""
, per_upload AS (
  SELECT job_id,
         COUNT(*) FILTER (WHERE "group" = 'antes') AS n_antes,
         COUNT(*) FILTER (WHERE "group" = 'despues') AS n_despues,
         COUNT(*) FILTER (WHERE "group" = 'evidencia') AS n_evidencia,
         bool_or(coalesce("group" NOT IN ('antes', 'despues', 'evidencia'), true)) AS bad_group,
         bool_or(coalesce(mime_type NOT IN ({_ALLOWED}), true)) AS bad_mime,
         bool_or(size_bytes > {S.UPLOAD_MAX_BYTES}) AS too_big
  FROM attachments GROUP BY job_id
), verdict AS (
  SELECT job_id, concat_ws(',', CASE WHEN n_antes > {S.ATTACHMENT_GROUP_LIMITS['antes']} THEN 'count:antes' END,
                                CASE WHEN n_despues > {S.ATTACHMENT_GROUP_LIMITS['despues']} THEN 'count:despues' END,
                                CASE WHEN n_evidencia > {S.ATTACHMENT_GROUP_LIMITS['evidencia']} THEN 'count:evidencia' END,
                                CASE WHEN bad_group THEN 'group' END,
                                CASE WHEN bad_mime THEN 'mime' END,
                                CASE WHEN too_big THEN 'size' END) AS reason
  FROM per_upload
)
SELECT a.id, a.job_id, v.reason = '' AS accepted, v.reason,
       CASE WHEN v.reason = '' THEN
         '/uploads/' || strftime(a.uploaded_at, '%Y-%m') || '/' || CAST(a.job_id AS VARCHAR) || '_'
         || strftime(a.uploaded_at, '%Y%m%d_%H%M%S') || '_' || substr(sha256(a.file_path), 1, 12) || '.'
         || coalesce(CASE a.mime_type {_EXTENSIONS} END, '{S.DEFAULT_EXTENSION}')
       END AS storage_path
FROM attachments a JOIN verdict v ON v.job_id = a.job_id
"""))
def attachment_check(m: DriverModel):
    """Each job's attachments as one upload: group limits, type and size;
    one breach rejects the whole upload.  Accepted files get a storage path."""
    checked = A.check_uploads(m.attachments, upload_col="job_id")
    return checked.select("id", "job_id", "accepted", "reason",
                          A.storage_path("job_id", "uploaded_at", "mime_type", "file_path")
                          .alias("storage_path_all"))\
        .withColumn("storage_path", F.when(F.col("accepted"), F.col("storage_path_all"))).drop("storage_path_all")
