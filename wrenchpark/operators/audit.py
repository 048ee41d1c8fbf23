"""Audit trail: rows written for every change, and the read-back with the
JSON detail parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import cut, first_forwarded, preview
from ..functions.timefmt import fmt_ts

JSON_OPTS = {"ignoreNullFields": "false"}    # JSON.stringify keeps nulls


def detail_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), JSON_OPTS)


def audit_from_history(history: DataFrame) -> DataFrame:
    """ESTADO_CAMBIADO rows {from, to, cerrado} from a status history."""
    return history.select(
        "job_id", "seq",
        F.lit("ESTADO_CAMBIADO").alias("action"),
        detail_json(F.col("from_status").alias("from"), F.col("to_status").alias("to"),
                    F.col("closed").alias("cerrado")).alias("detail"),
        F.col("ts").alias("logged_at"))


def audit_from_comments(comments: DataFrame) -> DataFrame:
    """COMENTARIO_AGREGADO rows {comentario: first 200 characters}."""
    return comments.select("job_id", F.lit("COMENTARIO_AGREGADO").alias("action"),
                           detail_json(preview("comment", S.PREVIEW_CHARS).alias("comentario")).alias("detail"))


def with_request(audit: DataFrame, forwarded_for: str | None = None, remote: str | None = None,
                 user_agent: str | None = None, actor_name: str | None = None,
                 actor_email: str | None = None) -> DataFrame:
    """Request columns of an audit row: first forwarded address (or the
    remote one), agent cut to 250 characters, default actor."""
    ip = first_forwarded(F.col(forwarded_for), F.col(remote) if remote else None) if forwarded_for else \
        (F.col(remote) if remote else F.lit(None).cast("string"))
    ua = cut(F.col(user_agent), S.USER_AGENT_MAX) if user_agent else F.lit(None).cast("string")
    return audit.withColumns({"ip": ip, "user_agent": ua,
                              "actor_name": F.lit(actor_name).cast("string"),
                              "actor_email": F.lit(actor_email).cast("string")})


def parsed(audit: DataFrame) -> DataFrame:
    """Audit rows newest first by id with the detail parsed (invalid JSON gives
    NULL) and the time as 'yyyy-MM-dd HH:mm:ss'."""
    return audit.select("id", "job_id", "action", "detail", "actor_name", "actor_email", "ip", "user_agent",
                        fmt_ts("logged_at").alias("logged_at"),
                        F.try_parse_json("detail").alias("detail_json"))


def audit_created(jobs: DataFrame) -> DataFrame:
    """CREADO rows {tipo_id, ubicacion_id, prioridad_id, fecha_objetivo} of new jobs."""
    return jobs.select(F.col("id").alias("job_id"), F.lit("CREADO").alias("action"),
                       detail_json(F.col("type_id").alias("tipo_id"), F.col("location_id").alias("ubicacion_id"),
                                   F.col("priority_id").alias("prioridad_id"),
                                   F.date_format("due_date", "yyyy-MM-dd").alias("fecha_objetivo")).alias("detail"),
                       F.col("created_at").alias("logged_at"))


def audit_uploaded(accepted_files: DataFrame, upload_col: str = "job_id") -> DataFrame:
    """ADJUNTO_SUBIDO rows {count}: one per upload with at least one saved file."""
    return (accepted_files.groupBy(upload_col).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col(upload_col).alias("job_id"), F.lit("ADJUNTO_SUBIDO").alias("action"),
                    detail_json(F.col("n").alias("count")).alias("detail")))


def audit_edited(updates: DataFrame, key: str = "target_id") -> DataFrame:
    """EDITADO rows {descripcion: first 200 characters}."""
    return updates.select(F.col(key).alias("job_id"), F.lit("EDITADO").alias("action"),
                          detail_json(preview("description", S.PREVIEW_CHARS).alias("descripcion")).alias("detail"))


def audit_deleted(deleted: DataFrame, what: str) -> DataFrame:
    """COMENTARIO_ELIMINADO {comentario_id} or ADJUNTO_ELIMINADO {adjunto_id}
    rows of deleted children (``deleted`` holds id and job_id)."""
    action, field = {"comment": ("COMENTARIO_ELIMINADO", "comentario_id"),
                     "attachment": ("ADJUNTO_ELIMINADO", "adjunto_id")}[what]
    return deleted.select("job_id", F.lit(action).alias("action"),
                          detail_json(F.col("id").alias(field)).alias("detail"))
