"""Operator 5: shards by a minimax contiguous partition.

Rows with equal texts form one atomic group.  Groups are ordered by a hash of
their text.  The smallest capacity C for which a greedy pass needs no more than
``n_shards`` shards is found by binary search, and the cuts are made there.

The order may hold billions of groups, so the driver never sees them all.  It
sees sums over ranges of the hash (65,536 at first).  From them it bounds where
each greedy cut can fall for any capacity still possible, and only the ranges
that hold such a place are split further (by 256) until each is one group.  The
search is then exact, on a list whose length depends on ``n_shards`` alone.

A group larger than the mean of what is left gets a shard of its own first;
otherwise its size would be the capacity of all shards and leave the last ones
empty.

Cases: a null text counts no bytes and has CRC 0, as an empty one; null or
repeated ids are rows like others; an empty table gives an empty result; fewer
groups than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bytes added to each row's size.
ROW_BYTES = 16
KEY_BITS = 60
TOP_BITS = 16
STEP_BITS = 8
ROWS_PER_CELL = 20_000


def greedy(pre: np.ndarray, capacity: int, n: int) -> list[int]:
    """Ends (as indices into ``pre``) of at most n shards, each as long as the capacity allows."""
    out, at = [], 0
    for _ in range(n):
        if at == len(pre) - 1:
            break
        at = max(at, int(np.searchsorted(pre, pre[at] + capacity, side="right")) - 1)
        out.append(at)
    return out


def least_capacity(sizes: np.ndarray, n: int, low: int | None = None) -> tuple[int, list[int]]:
    """The smallest capacity of n contiguous shards over atomic ``sizes``, and the cuts."""
    pre = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lo = max(int(sizes.max()), -(-int(pre[-1]) // n), low or 0)
    hi = max(lo, int(pre[-1]))
    while lo < hi:
        mid = (lo + hi) // 2
        ends = greedy(pre, mid, n)
        if ends and ends[-1] == len(pre) - 1:
            hi = mid
        else:
            lo = mid + 1
    return lo, greedy(pre, lo, n)


def _ranges(groups: DataFrame, shift: int) -> list:
    return (groups.groupBy(F.shiftrightunsigned("key", shift).alias("r"))
            .agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.max("w").alias("m")).collect())


def minimax_cuts(groups: DataFrame, n_shards: int) -> list[int]:
    """First keys of the second, third, ... shard over ``groups`` (key, w) in key order.

    What reaches the driver is bounded by 2^TOP_BITS ranges and 2^STEP_BITS
    parts of each range that may hold one of the n_shards cuts.
    """
    shift = KEY_BITS - TOP_BITS
    segs = {int(r.r) << shift: (shift, int(r.w), int(r.n), int(r.m)) for r in _ranges(groups, shift)}
    if not segs or n_shards < 2:
        return []
    while True:
        keys = sorted(segs)
        w = np.array([segs[k][1] for k in keys], np.int64)
        n = np.array([segs[k][2] for k in keys], np.int64)
        m = np.array([segs[k][3] for k in keys], np.int64)
        pre = np.concatenate([[0], np.cumsum(w)])
        total = int(pre[-1])
        low = max(int(m.max()), -(-total // n_shards))
        high, _ = least_capacity(w, n_shards, low)
        doubt = np.zeros(len(keys), bool)
        first = last = 0
        for _ in range(n_shards - 1):
            aim = first + low
            if aim >= total:
                break
            at = int(np.searchsorted(pre, aim, side="right")) - 1
            first = max(int(pre[at]), aim - int(m[at]))
            last = min(total, last + high)
            a = int(np.searchsorted(pre, first, side="right")) - 1
            b = min(len(keys) - 1, int(np.searchsorted(pre, last, side="right")) - 1)
            doubt[a:b + 1] = True
        split = [keys[i] for i in np.flatnonzero(doubt & (n > 1)) if segs[keys[i]][0] > 0]
        if not split:
            _, ends = least_capacity(w, n_shards, low)
            return [keys[e] for e in ends if e < len(keys)]
        for shift in sorted({segs[k][0] for k in split}):
            mine = [k for k in split if segs[k][0] == shift]
            spark = groups.sparkSession
            chosen = spark.createDataFrame([(k >> shift,) for k in mine], "p long")
            inside = groups.join(F.broadcast(chosen), F.shiftrightunsigned("key", shift) == F.col("p"), "left_semi")
            finer = max(0, shift - STEP_BITS)
            for k in mine:
                del segs[k]
            for r in _ranges(inside, finer):
                segs[int(r.r) << finer] = (finer, int(r.w), int(r.n), int(r.m))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; see the module's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("w"), F.count("*").alias("n")), "shard-groups")
    sums = groups.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    left, shards, alone = int(sums.w or 0), n_shards, []
    for g in groups.orderBy(F.desc("w"), "key").limit(n_shards - 1).collect() if n_shards > 1 else []:
        if int(g.w) * shards < left or shards < 2:
            break
        alone.append(int(g.key))
        left, shards = left - int(g.w), shards - 1
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    cuts = minimax_cuts(rest, shards)
    shard = F.lit(len(alone))
    if cuts:
        shard = shard + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key")))
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(i)).otherwise(shard)
    # Slots without a window over a shard: cells of bounded size, numbered inside, offset by the cells before.
    cells = max(1, -(-int(sums.n or 0) // (n_shards * ROWS_PER_CELL)))
    placed = rows.select("doc_id", "size", "text_crc32", "row", shard.cast("int").alias("shard"),
                         F.pmod(F.xxhash64("row"), F.lit(cells)).alias("cell"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "cell").agg(F.count("*").alias("c"))
               .select("shard", "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("shard", "cell").orderBy("row")
    numbered = placed.withColumn("i", F.row_number().over(inside) - 1)
    return (numbered.join(offsets, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("i")).cast("long").alias("slot")))


def op5_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` into 40 shards under the law ``bytes``."""
    from .common import table
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


