"""Registered queries: the summary report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators.filters import JobFilter
from ..sources.testdata import REPORT_FROM, REPORT_TO, DriverModel
from .oracle import q
from .registry import register

REPORT = JobFilter.for_report(date_from=REPORT_FROM, date_to=REPORT_TO)
RANGE_SQL = f"created_at >= TIMESTAMP '{REPORT_FROM} 00:00:00' AND created_at <= TIMESTAMP '{REPORT_TO} 23:59:59'"
# Means are shown rounded to 9 decimals so that both engines print the same value.
ROUND = 9


def _filtered(m: DriverModel):
    return REPORT.apply(m.jobs)


@register("top_providers", "A9, T3, X2", q(f"""
SELECT coalesce(nullif(trim(provider), ''), '—') AS provider, COUNT(*) AS total,
       CAST(SUM(coalesce(net_value, 0)) AS DECIMAL(38,2)) AS amount
FROM jobs WHERE {RANGE_SQL}
GROUP BY 1 ORDER BY amount DESC, total DESC, provider ASC LIMIT 10
"""))
def top_providers(m: DriverModel):
    return R.top_providers(_filtered(m))


@register("kpis", "A2, F13, K2", q(f"""
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE lower(s.name) <> 'cerrado') AS open,
       COUNT(*) FILTER (WHERE lower(s.name) = 'cerrado') AS closed,
       COUNT(*) FILTER (WHERE lower(s.name) <> 'cerrado' AND j.due_date IS NOT NULL
                         AND j.due_date < DATE '{REPORT_TO}') AS overdue
FROM jobs j JOIN statuses s ON s.id = j.status_id
WHERE {RANGE_SQL.replace('created_at', 'j.created_at')}
"""))
def kpis(m: DriverModel):
    return R.kpis(_filtered(m), m.catalogs(), REPORT_TO)


@register("closing_time", "A3, A4, W1, W2, F12, X8", q(f"""
SELECT round(AVG(CAST(date_diff('day', CAST(created_at AS DATE), CAST(closed_at AS DATE)) AS DOUBLE)), {ROUND}) AS avg_days_to_close,
       quantile_cont(date_diff('day', CAST(created_at AS DATE), CAST(closed_at AS DATE)), 0.5) AS median_days_to_close
FROM jobs j JOIN statuses s ON s.id = j.status_id
WHERE {RANGE_SQL} AND closed_at IS NOT NULL
"""))
def closing_time(m: DriverModel):
    c = R.closing_time(_filtered(m), m.catalogs())
    return c.select(F.round("avg_days_to_close", ROUND).alias("avg_days_to_close"), "median_days_to_close")


def _breakdown_sql(join: str, name: str) -> str:
    return q(f"""
SELECT {name} AS name, COUNT(*) AS total
FROM jobs j {join}
WHERE {RANGE_SQL.replace('created_at', 'j.created_at')}
GROUP BY 1
""")


@register("breakdown_status", "A5, J3, T4",
          _breakdown_sql("JOIN statuses c ON c.id = j.status_id", "c.name"))
def breakdown_status(m: DriverModel):
    return R.breakdown(_filtered(m), m.catalogs(), "status")


@register("breakdown_type", "A6, J3, T4",
          _breakdown_sql("JOIN types c ON c.id = j.type_id", "c.name"))
def breakdown_type(m: DriverModel):
    return R.breakdown(_filtered(m), m.catalogs(), "type")


@register("breakdown_location", "A7, J3, T4",
          _breakdown_sql("JOIN locations c ON c.id = j.location_id", "c.name"))
def breakdown_location(m: DriverModel):
    return R.breakdown(_filtered(m), m.catalogs(), "location")


@register("breakdown_priority", "A8, J2, T4",
          _breakdown_sql("LEFT JOIN priorities c ON c.id = j.priority_id", "coalesce(c.name, 'Sin prioridad')"))
def breakdown_priority(m: DriverModel):
    return R.breakdown(_filtered(m), m.catalogs(), "priority")


@register("breakdown_all", "A10", q(f"""
, f AS (SELECT * FROM jobs WHERE {RANGE_SQL})
SELECT 'status' AS dimension, c.name AS name, COUNT(*) AS total FROM f JOIN statuses c ON c.id = f.status_id GROUP BY 2
UNION ALL
SELECT 'type', c.name, COUNT(*) FROM f JOIN types c ON c.id = f.type_id GROUP BY 2
UNION ALL
SELECT 'location', c.name, COUNT(*) FROM f JOIN locations c ON c.id = f.location_id GROUP BY 2
UNION ALL
SELECT 'priority', coalesce(c.name, 'Sin prioridad'), COUNT(*) FROM f LEFT JOIN priorities c ON c.id = f.priority_id GROUP BY 2
"""))
def breakdown_all(m: DriverModel):
    return R.breakdown_all(_filtered(m), m.catalogs())


@register("report_document", "A11, S9", q(f"""
, f AS (SELECT j.*, s.name AS status FROM jobs j JOIN statuses s ON s.id = j.status_id
        WHERE {RANGE_SQL.replace('created_at', 'j.created_at')}),
k AS (
  SELECT COUNT(*) AS total,
         COUNT(*) FILTER (WHERE lower(status) <> 'cerrado') AS open,
         COUNT(*) FILTER (WHERE lower(status) = 'cerrado') AS closed,
         COUNT(*) FILTER (WHERE lower(status) <> 'cerrado' AND due_date IS NOT NULL AND due_date < DATE '{REPORT_TO}') AS overdue,
         round(AVG(CAST(date_diff('day', CAST(created_at AS DATE), CAST(closed_at AS DATE)) AS DOUBLE)), {ROUND}) AS avg_days_to_close,
         quantile_cont(date_diff('day', CAST(created_at AS DATE), CAST(closed_at AS DATE)), 0.5) AS median_days_to_close
  FROM f
),
fj AS (SELECT * FROM jobs WHERE {RANGE_SQL}),
bs AS (SELECT c.name, COUNT(*) AS total FROM fj JOIN statuses c ON c.id = fj.status_id GROUP BY 1),
bt AS (SELECT c.name, COUNT(*) AS total FROM fj JOIN types c ON c.id = fj.type_id GROUP BY 1),
bl AS (SELECT c.name, COUNT(*) AS total FROM fj JOIN locations c ON c.id = fj.location_id GROUP BY 1),
bp AS (SELECT coalesce(c.name, 'Sin prioridad') AS name, COUNT(*) AS total FROM fj LEFT JOIN priorities c ON c.id = fj.priority_id GROUP BY 1),
tp AS (SELECT coalesce(nullif(trim(provider), ''), '—') AS provider, COUNT(*) AS total,
              CAST(SUM(coalesce(net_value, 0)) AS DECIMAL(38,2)) AS amount
       FROM fj GROUP BY 1 ORDER BY amount DESC, total DESC, provider ASC LIMIT 10)
SELECT '{REPORT_FROM}' AS range_from, '{REPORT_TO}' AS range_to, k.total, k.open, k.closed, k.overdue,
       k.avg_days_to_close, k.median_days_to_close,
       (SELECT string_agg(name || '=' || total, '|' ORDER BY total DESC, name) FROM bs) AS by_status,
       (SELECT string_agg(name || '=' || total, '|' ORDER BY total DESC, name) FROM bt) AS by_type,
       (SELECT string_agg(name || '=' || total, '|' ORDER BY total DESC, name) FROM bl) AS by_location,
       (SELECT string_agg(name || '=' || total, '|' ORDER BY total DESC, name) FROM bp) AS by_priority,
       (SELECT string_agg(provider || '=' || total || '=' || amount, '|' ORDER BY amount DESC, total DESC, provider) FROM tp) AS providers
FROM k
"""))
def report_document(m: DriverModel):
    """The nested report; the registered form writes each array as one text
    with every name, total and amount in order."""
    doc = R.report_document(m.jobs, m.catalogs(), JobFilter.for_report(date_from=REPORT_FROM, date_to=REPORT_TO),
                            REPORT_TO)
    return doc.select(
        F.col("range.from").alias("range_from"), F.col("range.to").alias("range_to"),
        F.col("kpis.total").alias("total"), F.col("kpis.open").alias("open"),
        F.col("kpis.closed").alias("closed"), F.col("kpis.overdue").alias("overdue"),
        F.round("kpis.avg_days_to_close", ROUND).alias("avg_days_to_close"),
        F.col("kpis.median_days_to_close").alias("median_days_to_close"),
        *[_entries(c, "name", "total").alias(c) for c in ("by_status", "by_type", "by_location", "by_priority")],
        _entries("top_providers", "provider", "total", "amount").alias("providers"),
    )


def _entries(array: str, *fields: str):
    return F.array_join(F.transform(array, lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), "|")
