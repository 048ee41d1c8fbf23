"""Registered queries: sessions, login lockouts, daily audit counts, each as a
batch and as a stream job that is run over the table slice by slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.testdata import LOCK_DURATION, LOCK_MAX_FAILURES, LOCK_SECONDS, SESSION_GAP, DriverModel
from ..streaming import audit_feed, jobs, lockouts, sessions
from .oracle import q
from .registry import register


SESSIONS_SQL = q(f"""
, e AS (
  SELECT user_id, ts,
         CASE WHEN LAG(ts) OVER w IS NULL OR ts > LAG(ts) OVER w + INTERVAL '{SESSION_GAP}' THEN 1 ELSE 0 END AS s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), g AS (
  SELECT user_id, ts, SUM(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e
)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS n_events
FROM g GROUP BY user_id, sid
""")


@register("sessions", "Z1", SESSIONS_SQL)
def sessions_q(m: DriverModel):
    """Activity sessions of each user (idle gap of 12 hours on this data)."""
    return sessions.sessions(m.activity, "user_id", "ts", SESSION_GAP).drop("session_no")


@register("sessions_stream", "Z1", SESSIONS_SQL)
def sessions_stream(m: DriverModel):
    """The same sessions from the stream job: two starts, the second from its checkpoint."""
    return jobs.replay(m.activity, "ts", jobs.run_sessions, {"user_id": -1},
                       "user_id bigint, session_start timestamp_ntz, session_end timestamp_ntz, n_events bigint", gap=SESSION_GAP)


def _walk_sql(source: str) -> str:
    return q(f"""
, src AS ({source})
, a AS (
  SELECT key, ts, ok, seq, ROW_NUMBER() OVER (PARTITION BY key ORDER BY ts, seq) AS rn FROM src
), walk AS (
  SELECT key, rn, seq, false AS refused,
         (NOT ok AND 1 >= {LOCK_MAX_FAILURES}) AS fires_lock,
         CASE WHEN ok THEN 0 WHEN 1 >= {LOCK_MAX_FAILURES} THEN 0 ELSE 1 END AS cnt,
         CASE WHEN NOT ok AND 1 >= {LOCK_MAX_FAILURES} THEN ts + INTERVAL '{LOCK_DURATION}' END AS lock_until
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.key, a.rn, a.seq,
         (w.lock_until IS NOT NULL AND a.ts < w.lock_until) AS refused,
         (NOT (w.lock_until IS NOT NULL AND a.ts < w.lock_until) AND NOT a.ok AND w.cnt + 1 >= {LOCK_MAX_FAILURES}) AS fires_lock,
         CASE WHEN w.lock_until IS NOT NULL AND a.ts < w.lock_until THEN w.cnt
              WHEN a.ok THEN 0
              WHEN w.cnt + 1 >= {LOCK_MAX_FAILURES} THEN 0 ELSE w.cnt + 1 END AS cnt,
         CASE WHEN w.lock_until IS NOT NULL AND a.ts < w.lock_until THEN w.lock_until
              WHEN a.ok THEN NULL
              WHEN w.cnt + 1 >= {LOCK_MAX_FAILURES} THEN a.ts + INTERVAL '{LOCK_DURATION}'
              ELSE w.lock_until END AS lock_until
  FROM walk w JOIN a ON a.key = w.key AND a.rn = w.rn + 1
)
SELECT key, seq, refused, fires_lock, CASE WHEN refused OR fires_lock THEN lock_until END AS locked_until
FROM walk
""").replace("\nWITH statuses AS (", "\nWITH RECURSIVE statuses AS (", 1)


LOCKOUTS_SQL = _walk_sql("SELECT key, ts, ok, seq FROM login_attempts")


@register("lockouts", "Z2", LOCKOUTS_SQL)
def lockouts_q(m: DriverModel):
    """Login attempts (error = failure, purchase = success) with the lockout
    decision: 3 failures lock a key for 12 hours on this data."""
    d = lockouts.lockout_decisions(m.login_attempts, "key", "ts", "ok", "seq",
                                   max_failures=LOCK_MAX_FAILURES, lock=LOCK_DURATION)
    return d.select("key", "seq", "refused", "fires_lock", "locked_until")


@register("lockouts_stream", "Z2", LOCKOUTS_SQL)
def lockouts_stream(m: DriverModel):
    """The same decisions from the stream job, whose state outlives its starts."""
    d = jobs.replay(m.login_attempts, "ts", jobs.run_lockouts, {"key": "closing", "ok": True, "seq": -1},
                    "key string, ts timestamp_ntz, ok boolean, seq bigint, refused boolean, fires_lock boolean, locked_until timestamp_ntz",
                    max_failures=LOCK_MAX_FAILURES, lock_seconds=LOCK_SECONDS, idle_seconds=None)
    return d.select("key", "seq", "refused", "fires_lock", "locked_until")


@register("lockouts_hot", "Z2", _walk_sql("SELECT CAST(CAST(key AS BIGINT) % 3 AS VARCHAR) AS key, ts, ok, seq FROM login_attempts"))
def lockouts_hot(m: DriverModel):
    """The same attempts under three keys, each with a third of all rows."""
    a = m.login_attempts.withColumn("key", (F.col("key").cast("long") % 3).cast("string"))
    d = lockouts.lockout_decisions(a, "key", "ts", "ok", "seq", max_failures=LOCK_MAX_FAILURES, lock=LOCK_DURATION)
    return d.select("key", "seq", "refused", "fires_lock", "locked_until")


AUDIT_SQL = q("""
SELECT CAST(ts AS DATE) AS day, event_type AS action, COUNT(*) AS n FROM events GROUP BY 1, 2
""")


@register("audit_daily", "Z3", AUDIT_SQL)
def audit_daily(m: DriverModel):
    """Audit rows per action and day."""
    return audit_feed.daily_counts(m.audit)


@register("audit_stream", "Z3", AUDIT_SQL)
def audit_stream(m: DriverModel):
    """The same counts from the stream job: each day when the watermark has passed it."""
    return jobs.replay(m.audit, "logged_at", jobs.run_audit_daily, {"id": -1, "action": "closing"}, "day date, action string, n bigint")
