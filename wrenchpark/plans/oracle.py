"""DuckDB twins of the registered queries.

``PRELUDE`` defines the work-order tables over the driver's views with the
same rules as :mod:`wrenchpark.sources.testdata`; every oracle query is that
prelude followed by its own CTEs and SELECT.  Numeric types are cast so both
engines agree (DuckDB sums to HUGEINT / DECIMAL(38,s)).
"""

from __future__ import annotations

from ..functions.parse import DECIMAL_RE, EMAIL_RE, ISO_DATE_RE
from ..schema import STATUS_SEED
from ..sources.testdata import MIME_BY_MOD4, ORDER_PRIORITIES


def _values(rows: list[tuple[int, str]]) -> str:
    return ", ".join(f"({i}, '{name}')" for i, name in rows)


_FIXED = {"@number@": DECIMAL_RE, "@iso_date@": ISO_DATE_RE, "@email@": EMAIL_RE, "@statuses@": _values(STATUS_SEED),
          "@priorities@": _values(ORDER_PRIORITIES), "@mimes@": " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MIME_BY_MOD4))}

_PRELUDE = r"""
WITH statuses AS (
  SELECT CAST(id AS INTEGER) AS id, name FROM (VALUES @statuses@) v(id, name)
), priorities AS (
  SELECT CAST(id AS INTEGER) AS id, name FROM (VALUES @priorities@) v(id, name)
), locations AS (
  SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation
), types AS (
  SELECT CAST(DENSE_RANK() OVER (ORDER BY c_mktsegment) AS INTEGER) AS id, c_mktsegment AS name
  FROM (SELECT DISTINCT c_mktsegment FROM customer)
), jobs AS (
  SELECT o.o_orderkey AS id,
         o.o_orderdate + INTERVAL '1' HOUR * CAST(o.o_orderkey % 24 AS INTEGER) AS created_at,
         CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE c.c_name END AS created_by_name,
         CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE 'user' || CAST(o.o_custkey AS VARCHAR) || '@example.cl' END AS created_by_email,
         CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 11 = 0 THEN '   '
              ELSE ' ' || c.c_name || ' ' END AS provider,
         c.c_mktsegment || ' job ' || CAST(o.o_orderkey AS VARCHAR) AS description,
         CAST(c.c_nationkey AS INTEGER) AS location_id,
         CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'OC-' || CAST(o.o_orderkey AS VARCHAR) END AS purchase_order,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(o.o_totalprice AS DECIMAL(12,2)) END AS net_value,
         ty.id AS type_id,
         CAST(CASE o.o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS INTEGER) AS status_id,
         CAST(CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 17 <> 0
                   THEN o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_orderkey % 45 AS INTEGER)
                                      + INTERVAL '1' HOUR * CAST(o.o_orderkey % 19 AS INTEGER) END AS DATE) AS repair_date,
         CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE 'Clerk#' || CAST(o.o_custkey % 50 AS VARCHAR) END AS requested_by,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 17 <> 0
              THEN o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_orderkey % 45 AS INTEGER)
                                 + INTERVAL '1' HOUR * CAST(o.o_orderkey % 19 AS INTEGER) END AS closed_at,
         CASE WHEN o.o_orderkey % 2 = 0 THEN NULL ELSE 'Nota ' || o.o_orderpriority END AS notes,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) END AS priority_id,
         CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
              ELSE CAST(o.o_orderdate + INTERVAL '1' DAY * CAST(o.o_orderkey % 60 AS INTEGER) AS DATE) END AS due_date,
         CASE WHEN o.o_orderkey % 10 < 3 THEN 'Tecnico ' || CAST(o.o_orderkey % 7 AS VARCHAR) END AS owner_name,
         CASE WHEN o.o_orderkey % 10 < 2 THEN 'tecnico' || CAST(o.o_orderkey % 7 AS VARCHAR) || '@example.cl' END AS owner_email
  FROM orders o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN types ty ON ty.name = c.c_mktsegment
), star AS (
  SELECT j.*, s.name AS status, t.name AS job_type, l.name AS location, p.name AS priority
  FROM jobs j
  JOIN statuses s ON s.id = j.status_id
  JOIN types t ON t.id = j.type_id
  JOIN locations l ON l.id = j.location_id
  LEFT JOIN priorities p ON p.id = j.priority_id
), attachments AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey AS id,
         l_orderkey AS job_id,
         CASE l_returnflag WHEN 'A' THEN 'antes' WHEN 'N' THEN 'despues' ELSE 'evidencia' END AS "group",
         '/uploads/' || strftime(l_shipdate, '%Y-%m') || '/' || CAST(l_orderkey AS VARCHAR) || '_'
           || strftime(l_shipdate, '%Y%m%d') || '_' || CAST(l_linenumber AS VARCHAR) || '-'
           || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '.jpg' AS file_path,
         'part' || CAST(l_partkey AS VARCHAR) || '.jpg' AS original_name,
         l_shipdate AS uploaded_at,
         CASE CAST(l_partkey % 4 AS INTEGER) @mimes@ END AS mime_type,
         CAST(l_quantity * 110000 AS BIGINT) AS size_bytes,
         l_quantity AS quantity
  FROM lineitem
), comments AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS job_id, text AS comment, role AS author_name,
         role || '@example.cl' AS author_email,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(conv_id % 720 AS INTEGER)
                                          + INTERVAL '1' MINUTE * CAST(turn AS INTEGER) AS created_at
  FROM conversations
), audit AS (
  SELECT event_id AS id, user_id AS job_id, event_type AS action, props AS detail,
         CAST(NULL AS VARCHAR) AS actor_name, CAST(NULL AS VARCHAR) AS actor_email,
         '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1' AS ip, 'agent' AS user_agent, ts AS logged_at
  FROM events
), status_changes AS (
  SELECT user_id AS job_id,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                              WHEN 'signup' THEN 4 WHEN 'error' THEN 99 END AS INTEGER) AS status_id,
         ts, event_id AS seq
  FROM events
), login_attempts AS (
  SELECT CAST(user_id AS VARCHAR) AS key, ts, event_type = 'purchase' AS ok, event_id AS seq
  FROM events WHERE event_type IN ('error', 'purchase')
), incoming AS (
  SELECT o.o_orderkey AS record_id,
         CASE WHEN o.o_orderkey % 10 = 0 THEN '   ' WHEN o.o_orderkey % 10 = 1 THEN NULL
              ELSE '  Job ' || CAST(o.o_orderkey AS VARCHAR) || ' ' END AS description,
         CASE WHEN o.o_orderkey % 9 = 0 THEN '' WHEN o.o_orderkey % 9 = 1 THEN 'abc' WHEN o.o_orderkey % 9 = 2 THEN '0'
              WHEN o.o_orderkey % 9 = 3 THEN '1.0000000001' WHEN o.o_orderkey % 9 = 4 THEN '1.00000000000000000001'
              WHEN o.o_orderkey % 9 = 5 THEN '250e-1' WHEN o.o_orderkey % 45 = 6 THEN '1e400' WHEN o.o_orderkey % 45 = 15 THEN '3000000000'
              ELSE CAST(c.c_nationkey AS VARCHAR) END AS location_id,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 11 = 1 THEN '7.0'
              ELSE CAST(o.o_orderkey % 5 + 1 AS VARCHAR) END AS type_id,
         CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE CAST(o.o_orderkey % 4 + 1 AS VARCHAR) END AS status_id,
         CASE WHEN o.o_orderkey % 8 = 0 THEN '12,5' WHEN o.o_orderkey % 8 = 1 THEN '1.234,5'
              WHEN o.o_orderkey % 8 = 2 THEN 'abc' WHEN o.o_orderkey % 8 = 3 THEN '1e3'
              WHEN o.o_orderkey % 8 = 4 THEN '' ELSE CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS net_value,
         c.c_name AS created_by_name,
         CASE WHEN o.o_orderkey % 6 = 0 THEN 'a@b' WHEN o.o_orderkey % 6 = 1 THEN ' ana@example.cl '
              WHEN o.o_orderkey % 6 = 2 THEN 'bad @x.cl' END AS created_by_email,
         CASE WHEN o.o_orderkey % 7 = 0 THEN '2024-02-30' WHEN o.o_orderkey % 7 = 1 THEN '24-1-1'
              WHEN o.o_orderkey % 7 = 2 THEN NULL ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS repair_date,
         CASE WHEN o.o_orderkey % 5 = 0 THEN '' ELSE substr(o.o_orderpriority, 1, 1) END AS priority_id,
         CASE WHEN o.o_orderkey % 12 = 0 THEN '2024-13-01' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS due_date,
         CAST(NULL AS VARCHAR) AS owner_name,
         CASE WHEN o.o_orderkey % 10 = 3 THEN 'tec@example' WHEN o.o_orderkey % 10 = 4 THEN 'tec@example.cl' END AS owner_email,
         ' ' || c.c_name AS provider,
         CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 'OC-' || CAST(o.o_orderkey AS VARCHAR) END AS purchase_order,
         CAST(NULL AS VARCHAR) AS requested_by,
         CAST(NULL AS VARCHAR) AS notes
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
), validated AS (
  SELECT *,
    CASE WHEN length(d_t) > 0 THEN substr(d_t, 1, 4000) ELSE coalesce(description, '') END AS v_description,
    CASE WHEN TRY_CAST(regexp_extract(trim(location_id), '@number@', 0) AS DOUBLE) = floor(TRY_CAST(regexp_extract(trim(location_id), '@number@', 0) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(regexp_extract(trim(location_id), '@number@', 0) AS DOUBLE) AS INTEGER) END AS v_location_id,
    CASE WHEN TRY_CAST(regexp_extract(trim(type_id), '@number@', 0) AS DOUBLE) = floor(TRY_CAST(regexp_extract(trim(type_id), '@number@', 0) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(regexp_extract(trim(type_id), '@number@', 0) AS DOUBLE) AS INTEGER) END AS v_type_id,
    CASE WHEN TRY_CAST(regexp_extract(trim(status_id), '@number@', 0) AS DOUBLE) = floor(TRY_CAST(regexp_extract(trim(status_id), '@number@', 0) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(regexp_extract(trim(status_id), '@number@', 0) AS DOUBLE) AS INTEGER) END AS v_status_id,
    nullif(CASE WHEN TRY_CAST(regexp_extract(trim(priority_id), '@number@', 0) AS DOUBLE) = floor(TRY_CAST(regexp_extract(trim(priority_id), '@number@', 0) AS DOUBLE)) THEN TRY_CAST(TRY_CAST(regexp_extract(trim(priority_id), '@number@', 0) AS DOUBLE) AS INTEGER) END, 0) AS v_priority_id,
    CASE WHEN net_value IS NULL OR net_value = '' THEN NULL WHEN net_t = '' THEN CAST(0 AS DECIMAL(12,2))
         ELSE TRY_CAST(regexp_extract(net_t, '@number@', 0) AS DECIMAL(12,2)) END AS v_net_value,
    CASE WHEN length(cm_t) > 0 THEN cm_t END AS v_created_by_email,
    CASE WHEN length(om_t) > 0 THEN om_t END AS v_owner_email,
    CASE WHEN regexp_matches(rep_t, '@iso_date@') THEN TRY_CAST(rep_t AS DATE) END AS v_repair_date,
    CASE WHEN regexp_matches(due_t, '@iso_date@') THEN TRY_CAST(due_t AS DATE) END AS v_due_date
  FROM (
    SELECT *,
      regexp_replace(coalesce(description, ''), '^\s+|\s+$', '', 'g') AS d_t,
      trim(replace(net_value, ',', '.')) AS net_t,
      regexp_replace(created_by_email, '^\s+|\s+$', '', 'g') AS cm_t,
      regexp_replace(owner_email, '^\s+|\s+$', '', 'g') AS om_t,
      CASE WHEN length(trim(repair_date)) > 0 THEN trim(repair_date) END AS rep_t,
      CASE WHEN length(trim(due_date)) > 0 THEN trim(due_date) END AS due_t
    FROM incoming
  )
), checked AS (
  SELECT *,
    concat_ws(',',
      CASE WHEN length(regexp_replace(v_description, '^\s+|\s+$', '', 'g')) = 0 THEN 'description' END,
      CASE WHEN coalesce(v_location_id, 0) = 0 THEN 'location_id' END,
      CASE WHEN coalesce(v_type_id, 0) = 0 THEN 'type_id' END,
      CASE WHEN coalesce(net_value <> '', false) AND v_net_value IS NULL THEN 'net_value' END,
      CASE WHEN v_created_by_email IS NOT NULL AND NOT regexp_matches(v_created_by_email, '@email@') THEN 'created_by_email' END,
      CASE WHEN rep_t IS NOT NULL AND v_repair_date IS NULL THEN 'repair_date' END,
      CASE WHEN due_t IS NOT NULL AND v_due_date IS NULL THEN 'due_date' END,
      CASE WHEN v_owner_email IS NOT NULL AND NOT regexp_matches(v_owner_email, '@email@') THEN 'owner_email' END
    ) AS error_fields,
    concat_ws(',',
      CASE WHEN length(regexp_replace(v_description, '^\s+|\s+$', '', 'g')) = 0 THEN 'description' END,
      CASE WHEN coalesce(v_location_id, 0) = 0 THEN 'location_id' END,
      CASE WHEN coalesce(v_type_id, 0) = 0 THEN 'type_id' END,
      CASE WHEN coalesce(v_status_id, 0) = 0 THEN 'status_id' END,
      CASE WHEN coalesce(net_value <> '', false) AND v_net_value IS NULL THEN 'net_value' END,
      CASE WHEN v_created_by_email IS NOT NULL AND NOT regexp_matches(v_created_by_email, '@email@') THEN 'created_by_email' END,
      CASE WHEN rep_t IS NOT NULL AND v_repair_date IS NULL THEN 'repair_date' END,
      CASE WHEN due_t IS NOT NULL AND v_due_date IS NULL THEN 'due_date' END,
      CASE WHEN v_owner_email IS NOT NULL AND NOT regexp_matches(v_owner_email, '@email@') THEN 'owner_email' END
    ) AS update_error_fields
  FROM validated
)
"""
PRELUDE = _PRELUDE
for _name, _value in _FIXED.items():
    PRELUDE = PRELUDE.replace(_name, _value)


def q(body: str) -> str:
    """Prelude plus the query's own CTEs (written as ``, name AS (...)``) and SELECT."""
    body = body.strip()
    if body.startswith(","):
        return PRELUDE + body
    return PRELUDE + "\n" + body
