"""Date and time helpers.

Stored times are wall-clock values without zone (TIMESTAMP_NTZ).  Jobs never
read the clock themselves: "now" is an explicit ``as_of`` argument, so a
result can be repeated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c

SOURCE_ZONE = "America/Santiago"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"    # CONVERT(varchar(19), ts, 120)
DATE_FORMAT = "yyyy-MM-dd"           # CONVERT(varchar(10), d, 23)


def ts_lit(value: str | dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def date_lit(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")


def day_start(day: str) -> str:
    """'YYYY-MM-DD' to the first second of that day."""
    return f"{day} 00:00:00"


def day_end(day: str) -> str:
    """'YYYY-MM-DD' to the last whole second of that day (23:59:59.5 is outside)."""
    return f"{day} 23:59:59"


def fmt_ts(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), TS_FORMAT)


def fmt_date(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), DATE_FORMAT)


def fmt_date_or_blank(c: ColumnOrName) -> Column:
    return F.coalesce(fmt_date(c), F.lit(""))


def parse_ts(c: ColumnOrName) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text to TIMESTAMP_NTZ, NULL when invalid."""
    return F.try_to_timestamp(_c(c), F.lit(TS_FORMAT)).cast("timestamp_ntz")


def days_open(created_at: ColumnOrName, as_of: Column) -> Column:
    """Whole elapsed days from creation to ``as_of``, floored, never below 0."""
    created = _c(created_at)
    return F.when(created.isNotNull(),
                  F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("DAY", created, as_of)))


def overdue(due_date: ColumnOrName, status_name: ColumnOrName, as_of: Column) -> Column:
    """Open job whose due day ended before ``as_of`` (plain date compare)."""
    due = _c(due_date)
    return F.coalesce(due.isNotNull() & (F.lower(_c(status_name)) != F.lit("cerrado"))
                      & (F.to_date(as_of) > due), F.lit(False))


def midnights_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """DATEDIFF(day, start, end): calendar midnights crossed, may be negative."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def local_time(utc: ColumnOrName, zone: str = SOURCE_ZONE) -> Column:
    """Wall clock of ``zone`` at a UTC time, as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(utc).cast("timestamp_ntz"))


def local_now(zone: str = SOURCE_ZONE) -> Column:
    """Current wall clock of ``zone`` as TIMESTAMP_NTZ (for live use only)."""
    return local_time(F.current_timestamp(), zone)


def day_bounds(ts: ColumnOrName) -> tuple[Column, Column]:
    start = F.date_trunc("day", _c(ts)).cast("timestamp_ntz")
    return start, start + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' SECOND")


def js_round(c: ColumnOrName) -> Column:
    """Math.round: half rounds up (towards +infinity), also for negatives."""
    return F.floor(_c(c) + F.lit(0.5))
