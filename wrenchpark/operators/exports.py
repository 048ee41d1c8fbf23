"""Export rows: the list filter without paging, as plain rows, labelled rows
or CSV text lines.

Exports are written by the executors (see :mod:`wrenchpark.sources.sinks`);
nothing is gathered on the driver.  The row cap the source system documents
(but does not enforce) is an explicit argument, off by default.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.timefmt import fmt_date_or_blank, fmt_ts
from .dims import Dim
from .filters import JobFilter
from .listing import enrich, newest_first, star

EXPORT_COLUMNS = ["id", "created_at", "status", "job_type", "location", "priority", "provider",
                  "description", "purchase_order", "net_value", "requested_by", "repair_date",
                  "due_date", "owner_name", "owner_email", "days_open", "overdue"]


def export_rows(jobs: DataFrame, catalogs: Mapping[str, Dim], filt: JobFilter | None, as_of: str,
                max_rows: int | None = None, ordered: bool = True) -> DataFrame:
    """Export rows newest first: 15 job columns (created_at as
    'yyyy-MM-dd HH:mm:ss' text), days open and the overdue flag."""
    df = star((filt or JobFilter()).apply(jobs), catalogs)
    df = enrich(df, as_of)
    if ordered or max_rows:
        df = newest_first(df)
    if max_rows:
        df = df.limit(max_rows)
    return df.select(*[fmt_ts("created_at").alias("created_at") if c == "created_at" else F.col(c)
                       for c in EXPORT_COLUMNS])


def labelled(rows: DataFrame) -> DataFrame:
    """Spreadsheet form: optional dates as ISO text or '', overdue as SI / NO,
    and the heading labels as column names."""
    conv: dict[str, Column] = {
        "repair_date": fmt_date_or_blank("repair_date"),
        "due_date": fmt_date_or_blank("due_date"),
        "overdue": F.when(F.col("overdue"), F.lit("SI")).otherwise(F.lit("NO")),
    }
    return rows.select(*[conv.get(c, F.col(c)).alias(label) for c, label in S.EXPORT_LABELS])


def csv_field(c: Column) -> Column:
    """One CSV field: NULL as empty, quoted (inner quotes doubled) when the text
    holds a quote, the separator, CR or LF."""
    s = c.cast("string")
    return (F.when(s.isNull(), F.lit(""))
             .when(s.rlike(r'[";\n\r]'),
                   F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))
             .otherwise(s))


def csv_lines(rows: DataFrame, sep: str = ";") -> DataFrame:
    """Each row as its CSV text line (dates as ISO), keyed by id for ordering."""
    fields = []
    for c in EXPORT_COLUMNS:
        col = F.col(c)
        if c in ("repair_date", "due_date"):
            col = F.date_format(col, "yyyy-MM-dd")
        fields.append(csv_field(col))
    return rows.select(F.col("id"), F.concat_ws(sep, *fields).alias("line"))


def csv_header(sep: str = ";") -> str:
    return sep.join(EXPORT_COLUMNS)
