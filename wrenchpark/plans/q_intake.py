"""Registered queries: attachment intake, catalog seeds, times, paths and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import timefmt as TF
from ..operators import attachments as A
from ..operators import ingest as I
from ..sources.testdata import DriverModel
from .oracle import q
from .registry import register


def _values(seed: list[tuple[int, str]]) -> str:
    return ", ".join(f"({i}, '{name}')" for i, name in seed)


@register("attachments_registered", "S11, M10, W3, X23, X24", q(f"""
, arrived AS (
  SELECT id, job_id, "group", mime_type, size_bytes, uploaded_at,
         CAST(id AS VARCHAR) || CASE mime_type WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/png' THEN '.PNG'
                                     WHEN 'image/webp' THEN '.webp' ELSE '.pdf' END AS name
  FROM attachments
), refused AS (
  SELECT job_id FROM arrived GROUP BY job_id
  HAVING {" OR ".join(f'''COUNT(*) FILTER (WHERE "group" = '{g}') > {n}''' for g, n in S.ATTACHMENT_GROUP_LIMITS.items())}
      OR bool_or(mime_type = 'application/pdf') OR bool_or(size_bytes > {S.UPLOAD_MAX_BYTES})
), saved AS (
  SELECT *, '/intake/' || CAST(job_id AS VARCHAR) || '/' || "group" || '/' || name AS path
  FROM arrived WHERE job_id NOT IN (SELECT job_id FROM refused)
)
SELECT (SELECT MAX(id) FROM attachments) + ROW_NUMBER() OVER (
         ORDER BY job_id, CASE "group" WHEN 'antes' THEN 1 WHEN 'despues' THEN 2 ELSE 3 END, path) AS id,
       job_id, "group",
       '/uploads/' || strftime(uploaded_at, '%Y-%m') || '/' || CAST(job_id AS VARCHAR) || '_'
         || strftime(uploaded_at, '%Y%m%d_%H%M%S') || '_' || substr(sha256(path), 1, 12) || lower(substr(name, strpos(name, '.'))) AS file_path,
       name AS original_name, CAST(uploaded_at AS TIMESTAMP) AS uploaded_at
FROM saved
"""))
def attachments_registered(m: DriverModel):
    """From a manifest of arrived files to checked, numbered attachment rows:
    each job's files are one upload, one breach refuses the whole upload."""
    a = m.attachments
    ends = F.when(F.col("mime_type") == "image/jpeg", ".jpg").when(F.col("mime_type") == "image/png", ".PNG") \
        .when(F.col("mime_type") == "image/webp", ".webp").otherwise(".pdf")
    arrived = a.select(F.concat(F.lit("/intake/"), F.col("job_id").cast("string"), F.lit("/"), F.col("group"), F.lit("/"),
                                F.col("id").cast("string"), ends).alias("path"),
                       F.col("uploaded_at").alias("modificationTime"), F.col("size_bytes").alias("length"))
    checked = A.check_uploads(A.from_manifest(arrived), upload_col="job_id")
    return A.register_uploads(checked, a)


@register("seed_catalogs", "M11", q(f"""
, first_types AS (SELECT DISTINCT t.id, t.name FROM jobs j JOIN types t ON t.id = j.type_id),
first_locations AS (SELECT DISTINCT l.id, l.name FROM jobs j JOIN locations l ON l.id = j.location_id WHERE j.created_at > now()::TIMESTAMP),
urgent AS (SELECT DISTINCT p.id, p.name FROM jobs j JOIN priorities p ON p.id = j.priority_id)
SELECT 'type' AS catalog, CAST(id AS INTEGER) AS id, name FROM (VALUES {_values(S.TYPE_SEED)}) v(id, name)
WHERE NOT EXISTS (SELECT 1 FROM first_types)
UNION ALL SELECT 'location', CAST(id AS INTEGER), name FROM (VALUES {_values(S.LOCATION_SEED)}) v(id, name)
WHERE NOT EXISTS (SELECT 1 FROM first_locations)
UNION ALL SELECT 'priority', CAST((SELECT MAX(id) FROM urgent) + ROW_NUMBER() OVER (ORDER BY id) AS INTEGER), name
FROM (VALUES {_values(S.PRIORITY_SEED)}) v(id, name) WHERE lower(name) NOT IN (SELECT lower(name) FROM urgent)
"""))
def seed_catalogs(m: DriverModel):
    """Seed rows of three catalogs: types as the jobs use them (not empty, so
    none), locations of jobs from the future (empty, so all), and the
    priorities whose names the used ones lack, numbered above them."""
    def used(column: str, catalog, jobs: DataFrame) -> DataFrame:
        ids = jobs.select(column).distinct()
        return ids.join(catalog.for_join(), ids[column] == F.col("id")).select("id", "name")

    future = m.jobs.where(F.col("created_at") > F.current_timestamp().cast("timestamp_ntz"))
    parts = [I.seed_missing(used("type_id", m.types, m.jobs), S.TYPE_SEED, True, "type"),
             I.seed_missing(used("location_id", m.locations, future), S.LOCATION_SEED, True, "location"),
             I.seed_missing(used("priority_id", m.priorities, m.jobs), S.PRIORITY_SEED, False, "priority")]
    return reduce(DataFrame.unionByName, parts)


@register("parse_times", "X6", q("""
, t AS (SELECT event_id, CASE event_type WHEN 'error' THEN strftime(ts, '%Y-%m-%d') WHEN 'signup' THEN '2024-02-30 10:00:00'
                         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events)
SELECT event_id, raw, CASE WHEN length(raw) = 19 THEN try_strptime(raw, '%Y-%m-%d %H:%M:%S') END AS parsed FROM t
"""))
def parse_times(m: DriverModel):
    """Time texts read back; a text without a time and a day that is none give NULL."""
    raw = (F.when(F.col("event_type") == "error", TF.fmt_date("ts")).when(F.col("event_type") == "signup", "2024-02-30 10:00:00")
           .otherwise(TF.fmt_ts("ts")))
    return m.read("events", ["event_id", "event_type", "ts"]).select("event_id", raw.alias("raw"), TF.parse_ts(raw).alias("parsed"))


@register("local_times", "X21, X22", q(f"""
, t AS (SELECT event_id, timezone('{TF.SOURCE_ZONE}', timezone('UTC', ts)) AS local FROM events)
SELECT event_id, local, date_trunc('day', local)::TIMESTAMP AS day_start,
       date_trunc('day', local)::TIMESTAMP + INTERVAL '1' DAY - INTERVAL '1' SECOND AS day_end
FROM t
"""))
def local_times(m: DriverModel):
    """Event times on the source system's wall clock, with the bounds of that day."""
    rows = m.read("events", ["event_id", "ts"]).select("event_id", TF.local_time("ts").alias("local"))
    start, end = TF.day_bounds("local")
    return rows.select("event_id", "local", start.alias("day_start"), end.alias("day_end"))


@register("safe_paths", "X25", q(r"""
, p AS (SELECT id, CASE "group" WHEN 'antes' THEN replace(file_path, '/', '\') WHEN 'despues' THEN '/srv' || file_path ELSE file_path END AS path
        FROM attachments)
SELECT id, path, CASE WHEN starts_with(replace(path, '\', '/'), '/uploads/') THEN substr(replace(path, '\', '/'), 10) END AS relative_path FROM p
"""))
def safe_paths(m: DriverModel):
    """Stored paths relative to the upload root: backslashes turned, others outside it NULL."""
    path = (F.when(F.col("group") == "antes", F.translate("file_path", "/", "\\"))
            .when(F.col("group") == "despues", F.concat(F.lit("/srv"), F.col("file_path"))).otherwise(F.col("file_path")))
    return m.attachments.select("id", path.alias("path"), A.safe_relative(path).alias("relative_path"))


@register("rounded_sizes", "X27", q("""
SELECT id, CAST(floor(size_bytes / 4000.0 + 0.5) AS BIGINT) AS up, CAST(floor(-size_bytes / 4000.0 + 0.5) AS BIGINT) AS down FROM attachments
"""))
def rounded_sizes(m: DriverModel):
    """Rounding with halves towards +infinity, for a number and its negative."""
    n = F.col("size_bytes") / F.lit(4000.0)
    return m.attachments.select("id", TF.js_round(n).alias("up"), TF.js_round(-n).alias("down"))
