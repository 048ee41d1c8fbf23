"""Ordered scans per key that stay parallel when one key is huge.

A window ``partitionBy(key).orderBy(ts)`` sends every row of a key to one
task; if one key holds a third of the rows, that task holds a third of the
data.  Here the order is cut into (key, bucket) pieces, each piece is scanned
by its own window, and a small table with one summary row per piece carries
values across piece boundaries:

* ``previous``  - value of the previous row in key order (lag);
* ``running``   - running sum in key order (inclusive);
* ``last_seen`` - last non-NULL value up to the row (forward fill).

The summary window runs over one row per (key, bucket), so its size is the
number of buckets of a key, not its number of rows.  The bucket must be a
monotone function of the order (e.g. the hour or day of the timestamp), fine
enough that one (key, bucket) fits a task.

With ``previous`` the pieces and their summary share one exchange by (key,
bucket), so the input is computed once.  For that the summary takes whole rows,
or column pruning would make two different exchanges of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

B = "__bucket"
RN = "__rn"


def scan(df: DataFrame, key: str | Sequence[str], order: Sequence[str], bucket: Column,
         previous: Sequence[str] = (), running: Sequence[str] = (),
         last_seen: Sequence[str] = ()) -> DataFrame:
    """Add ``prev_<c>`` for ``previous``, ``run_<c>`` for ``running`` and
    ``last_<c>`` for ``last_seen`` columns, in (key, order) order."""
    keys = [key] if isinstance(key, str) else list(key)
    pieces = df.withColumn(B, bucket)
    if previous:
        pieces = pieces.repartition(*keys, B)
    d = pieces
    w = Window.partitionBy(*keys, B).orderBy(*order)
    wrun = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn(RN, F.row_number().over(w))
    for c in previous:
        d = d.withColumn(f"prev_{c}", F.lag(c).over(w))
    for c in running:
        d = d.withColumn(f"run_{c}", F.sum(c).over(wrun))
    for c in last_seen:
        d = d.withColumn(f"last_{c}", F.last(c, ignorenulls=True).over(wrun))

    # One summary row per (key, bucket).
    aggs = []
    if previous:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(o) for o in order]))
                    .alias("__tail"))
    for c in running:
        aggs.append(F.sum(c).alias(f"__sum_{c}"))
    for c in last_seen:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*[F.col(o) for o in order])))
                    .alias(f"__last_{c}"))
    if not aggs:
        return d.drop(B, RN)
    summ = pieces.groupBy(*keys, B).agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy(B)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [*keys, B]
    sel = [F.col(k) for k in carry_cols]
    if previous:
        sel.append(F.lag("__tail").over(wb).alias("__carry_prev"))      # one whole row a piece
    for c in running:
        sel.append(F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__carry_run_{c}"))
    for c in last_seen:
        sel.append(F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__carry_last_{c}"))
    carry = summ.select(*sel)

    out = d.join(carry, carry_cols, "left")
    fixes = {}
    for c in previous:
        fixes[f"prev_{c}"] = F.when(F.col(RN) == 1, F.col(f"__carry_prev.{c}")).otherwise(F.col(f"prev_{c}"))
    for c in running:
        fixes[f"run_{c}"] = F.col(f"run_{c}") + F.col(f"__carry_run_{c}")
    for c in last_seen:
        fixes[f"last_{c}"] = F.coalesce(F.col(f"last_{c}"), F.col(f"__carry_last_{c}"))
    out = out.withColumns(fixes)
    drop = [B, RN] + [c for c in out.columns if c.startswith("__carry")]
    return out.drop(*drop)
