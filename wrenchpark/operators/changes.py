"""Batches of changes: full updates, status changes, deletes and cascades.

The source system applies one change per request.  Here a batch of changes
is folded into the table by key: the last change of each id wins (a hash
aggregate of the order alone, so a hot id is combined on every task before the
shuffle, and the winners joined back), and the result is a new snapshot.  Nothing is
updated in place; snapshots are written to new paths.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .dims import Dim, as_dim
from .ingest import split_known
from .ordered import scan

# Columns a full update replaces (created_at and closed_at stay as they are).
UPDATE_COLUMNS = ["created_by_name", "created_by_email", "provider", "description", "location_id",
                  "purchase_order", "net_value", "type_id", "status_id", "repair_date", "requested_by",
                  "notes", "priority_id", "due_date", "owner_name", "owner_email"]


def _order_code(changes: DataFrame, order: list[str]) -> Column | None:
    """One number that sorts like the ``order`` columns, if these are a whole
    number or a time and a whole number; NULLs come first."""
    kinds = [changes.schema[o].dataType for o in order]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    times = (T.TimestampType, T.TimestampNTZType)
    if not kinds or len(kinds) > 2 or not isinstance(kinds[-1], whole) or (len(kinds) == 2 and not isinstance(kinds[0], times)):
        return None
    # 20 digits hold any 64-bit number moved above zero; 0 is NULL.  A time is below 18 digits of microseconds.
    number = lambda text, kind: F.lit(text).cast(kind)
    low = F.coalesce(F.col(order[-1]).cast("decimal(20,0)") + number(str((1 << 63) + 1), "decimal(20,0)"), F.lit(0)).cast("decimal(38,0)")
    if len(kinds) == 1:
        return low
    micros = F.coalesce(F.unix_micros(F.col(order[0]).cast("timestamp_ltz")).cast("decimal(18,0)"), number(str(1 - 10**18), "decimal(18,0)"))
    return ((micros * number(str(10**20), "decimal(21,0)")).cast("decimal(38,0)") + low).cast("decimal(38,0)")


def last_per_key(changes: DataFrame, key: str, order: list[str], values: list[str], out: str = "last") -> DataFrame:
    """The values of the latest change of each key, as one struct column.

    The order columns alone are aggregated (a number per key, which Spark
    does in a hash table on every task before the shuffle), and the winning
    rows are joined back by key and order, so that a key with very many changes
    is spread over the join's tasks.  Changes of equal order are told apart by a
    hash of their values.  Orders that do not fit one number go through ``max_by``.
    """
    code = _order_code(changes, order)
    row = F.struct(*[F.col(v) for v in values])
    if code is None:
        return changes.groupBy(key).agg(F.max_by(row, F.struct(*[F.col(o) for o in order])).alias(out))
    rows = changes.select(F.col(key), row.alias(out), code.alias("__code"))
    best = changes.select(F.col(key).alias("__key"), code.alias("__best")).groupBy("__key").agg(F.max("__best").alias("__best"))
    won = rows.join(best, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__code") == F.col("__best"))).select(key, out)
    first = Window.partitionBy(key).orderBy(F.xxhash64(out))
    return won.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def apply_updates(jobs: DataFrame, updates: DataFrame, key: str = "target_id",
                  order: list[str] | None = None,
                  catalogs: Mapping[str, Dim] | None = None) -> tuple[DataFrame, DataFrame]:
    """Full-row replace of the update columns; absent values become NULL.

    With ``catalogs``, an update that names a missing status, type, location
    or priority is refused before the last update of an id is chosen, so it
    never wins over an earlier valid one (:func:`update_rejects` lists it).
    Returns (new snapshot, updates whose id does not exist).
    """
    order = order or ["seq"]
    not_found = updates.join(jobs.select(F.col("id").alias(key)), key, "left_anti")
    if catalogs is not None:
        updates, _ = split_known(updates, catalogs)
    last = last_per_key(updates, key, order, UPDATE_COLUMNS)
    j = jobs.alias("j").join(last.alias("u"), F.col("j.id") == F.col(f"u.{key}"), "left")
    matched = F.col(f"u.{key}").isNotNull()
    cols = []
    for c in jobs.columns:
        if c in UPDATE_COLUMNS:
            cols.append(F.when(matched, F.col(f"u.last.{c}")).otherwise(F.col(f"j.{c}"))
                        .cast(jobs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"j.{c}"))
    snapshot = j.select(*cols)
    return snapshot, not_found


def update_rejects(jobs: DataFrame, updates: DataFrame, catalogs: Mapping[str, Dim], key: str = "target_id") -> DataFrame:
    """Updates of existing jobs that name a missing catalog row, with the reason."""
    _, refused = split_known(updates, catalogs)
    return refused.join(jobs.select(F.col("id").alias(key)), key, "left_semi")


def _is_closed(statuses: Dim, status_col: str) -> tuple[DataFrame, Column]:
    st = as_dim(statuses).for_join().select(F.col("id").alias("__sid"),
                                            (F.lower("name") == F.lit(S.CLOSED_STATUS)).alias("__closed"))
    return st, F.col(status_col) == F.col("__sid")


def valid_status_changes(jobs: DataFrame, changes: DataFrame,
                         statuses: Dim) -> tuple[DataFrame, DataFrame]:
    """Split changes (job_id, status_id, ts, seq) into applicable ones (with a
    ``closes`` flag and the job's ``prior_status`` before the batch) and
    rejected ones with a reason: ``invalid`` (no status), ``fk:estado``
    (unknown status) or ``not_found`` (unknown job)."""
    st, cond = _is_closed(statuses, "status_id")
    # One join to the catalog and one to the job table decide every change.
    cur = jobs.select(F.col("id").alias("__job"), F.col("status_id").alias("prior_status"))
    reason = (F.when(F.coalesce(F.col("status_id"), F.lit(0)) == 0, "invalid").when(F.col("__sid").isNull(), "fk:estado")
               .when(F.col("__job").isNull(), "not_found"))
    c = (changes.join(st, cond, "left").join(cur, F.col("job_id") == F.col("__job"), "left")
         .withColumn("reason", reason))
    valid = c.where(F.col("reason").isNull()).select(*changes.columns, F.col("__closed").alias("closes"), "prior_status")
    return valid, c.where(F.col("reason").isNotNull()).select(*changes.columns, "reason")


def apply_status_changes(jobs: DataFrame, changes: DataFrame, statuses: Dim) -> DataFrame:
    """New snapshot after a batch of status changes: each job takes the status
    of its last applicable change; closed_at becomes that change's time when
    the status is the closed one, NULL otherwise."""
    # A change of an unknown job finds no row in the final left join, so only
    # the status needs checking here; the job table is read once.
    st, cond = _is_closed(statuses, "status_id")
    known = (changes.where(F.coalesce(F.col("status_id"), F.lit(0)) != 0).join(st, cond)
             .withColumn("closes", F.col("__closed")))
    last = last_per_key(known, "job_id", ["ts", "seq"], ["status_id", "ts", "closes"])
    j = jobs.alias("j").join(last.alias("c"), F.col("j.id") == F.col("c.job_id"), "left")
    hit = F.col("c.job_id").isNotNull()
    out = []
    for c in jobs.columns:
        if c == "status_id":
            out.append(F.when(hit, F.col("c.last.status_id")).otherwise(F.col("j.status_id")).alias(c))
        elif c == "closed_at":
            out.append(F.when(hit, F.when(F.col("c.last.closes"), F.col("c.last.ts")))
                       .otherwise(F.col("j.closed_at")).cast("timestamp_ntz").alias(c))
        else:
            out.append(F.col(f"j.{c}"))
    return j.select(*out)


def status_history(jobs: DataFrame, changes: DataFrame, statuses: Dim,
                   bucket: Column | None = None) -> DataFrame:
    """Each applicable change with the status it replaced (``from_status``):
    the previous applicable change of the job, or the job's status before the
    batch for its first change.  The ordered scan is bucketed by hour (``bucket``:
    another monotone column of ``ts``), so a job with very many changes, even on
    one day, is not one task."""
    valid, _ = valid_status_changes(jobs, changes, statuses)
    b = bucket if bucket is not None else F.date_trunc("hour", F.col("ts"))
    # Stated here, or it would be inferred for one side of the scan's join only and keep both from sharing their exchange.
    valid = valid.where(F.col("job_id").isNotNull())
    h = scan(valid, "job_id", ["ts", "seq"], b, previous=["status_id"])
    return h.select("job_id", "seq", "ts", F.coalesce("prev_status_id", "prior_status").alias("from_status"),
                    F.col("status_id").alias("to_status"), F.col("closes").alias("closed"))


def delete_rows(table: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows left after deleting ``ids``, and the ids that did not exist."""
    i = ids.select(F.col(key)).distinct()
    return table.join(i, key, "left_anti"), i.join(table.select(key), key, "left_anti")


def cascade_delete(children: Mapping[str, DataFrame], deleted_jobs: DataFrame,
                   fk: str = "job_id") -> dict[str, DataFrame]:
    """Children of deleted jobs vanish with them (ON DELETE CASCADE)."""
    gone = deleted_jobs.select(F.col("id").alias(fk)).distinct()
    return {name: df.join(gone, fk, "left_anti") for name, df in children.items()}
