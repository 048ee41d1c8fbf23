"""Login lockout: ``max_failures`` failed attempts of one key lock it for
``lock`` time.

Rules: an attempt while locked (time < lock end) is refused and changes
nothing; a success clears the failure count; a failure adds one, and the
``max_failures``-th failure starts the lock and resets the count to 0.  An
attempt exactly at the lock end is accepted.  Failures never expire.

Batch form, exact, and the same for keys of every size: attempts are cut into
(key, time bucket) pieces, and each piece becomes one map from the state before
it to the state after it.  A state is a failure count, or a lock with its end.

1. A piece's map holds one state for each count, and for a lock one state for
   each run of lock ends that leave the piece alike.  All starts inside a piece
   are followed at once: an *epoch* begins without failures and ends at the next
   success, or at the failure that fires a lock; what comes next is known for
   each row, and pointer doubling in the task leads every start to its end.
2. One pass over the maps of a key in time order composes them: it carries the
   state from piece to piece and gives each piece the state it begins with.
3. The pieces are read again from the same exchange, each with its state, and
   every attempt gets its decision.

A key that holds a third of all rows is spread over its buckets; only its maps
meet in one task, read one after the other.

Stream form: ``transformWithState`` keyed by the login key.  Attempts wait in the
state, with a timer at the first of them, and are folded once, in (ts, seq) order,
when the watermark has passed them, so batches may bring them in any order.  Few
waiting attempts of a key are in one value; more are in pieces, which are not written
again and are merged when their time comes.  The count and the lock end stay for
good, as in the source, unless an idle limit is asked for.

Attempts without a key or a time take no part; a missing outcome is a failure.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime, timedelta
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: "No lock" among lock ends, which are microseconds.
NONE = np.iinfo(np.int64).min
_BUCKET = "__bucket"


def _whole_pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete pieces with the pieces' borders, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []

    def table() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(c[1:], c[:-1]))
        return t, np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        last = [b.column(b.schema.get_field_index(k)) for k in keys]
        if all(c[0] == c[-1] for c in last) and all(held[0].column(b.schema.get_field_index(k))[0] == c[-1] for k, c in zip(keys, last, strict=True)):
            continue
        t, border = table()
        cut = int(border[-2])
        yield t.slice(0, cut), border[:-1]
        held = t.slice(cut).to_batches()
    if held:
        yield table()


def _micros(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().cast(pa.timestamp("us")).cast(pa.int64()))


class _Walk:
    """The epochs of pieces, row by row: ``border`` are the n+1 borders of the pieces."""

    def __init__(self, ts: np.ndarray, ok: np.ndarray, border: np.ndarray, max_failures: int, lock: int):
        self.ts, self.first, self.max, self.lock = ts, border[:-1], max_failures, lock
        n = len(ts)
        self.piece = np.repeat(np.arange(len(border) - 1), np.diff(border))
        self.stop = border[1:][self.piece]
        success = np.where(ok, np.arange(n), n)
        self.success = np.minimum(np.minimum.accumulate(success[::-1])[::-1], self.stop)
        self.base = ts[self.first]
        self.width = int((ts - self.base[self.piece]).max(initial=0)) + 2
        self.order = self.piece * self.width + ts - self.base[self.piece]
        self.end, self.until, self.next = self.epoch(np.arange(n), np.full(n, max_failures))
        last = np.where(self.next < self.stop, self.next, np.arange(n))
        while (last[last] != last).any():
            last = last[last]
        self.count_after, self.until_after = self._left(last, self.max)

    def at_or_after(self, piece: np.ndarray, time: np.ndarray) -> np.ndarray:
        """First row of each piece at or after a time, or the piece's end."""
        since = np.clip(time - self.base[piece], 0, self.width - 1)
        return np.searchsorted(self.order, piece * self.width + since)

    def epoch(self, at: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last row, lock end or NONE, next start) of the epochs that begin at rows and need so many failures for a lock."""
        stop, success = self.stop[at], self.success[at]
        good = success < np.minimum(at + need, stop)
        fires = ~good & (at + need <= stop)
        fired = np.where(fires, at + need - 1, at)
        until = np.where(fires, self.ts[fired] + self.lock, NONE)
        end = np.where(good, success, np.where(fires, fired, stop - 1))
        after = self.at_or_after(self.piece[at], np.where(fires, until, self.ts[at]))
        return end, until, np.where(good, success + 1, np.where(fires, after, stop))

    def _left(self, at: np.ndarray, need) -> tuple[np.ndarray, np.ndarray]:
        """State behind the piece of epochs that no other follows there."""
        open_ = (self.until[at] == NONE) & (self.success[at] >= self.stop[at])
        return np.where(open_, self.max - need + self.stop[at] - at, 0), self.until[at]

    def through(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """State behind each piece that begins with ``count`` failures."""
        at, need = self.first, self.max - count
        _, until, after = self.epoch(at, np.full(len(at), need))
        stop = self.stop[at]
        more = after < stop
        to = np.where(more, after, at)
        open_ = (until == NONE) & (self.success[at] >= stop)
        return np.where(more, self.count_after[to], np.where(open_, count + stop - at, 0)), np.where(more, self.until_after[to], until)

    def steps(self, limit: np.ndarray) -> np.ndarray:
        """Rows that tell apart what a lock's end does to a piece: the last of each run of equal outcomes.

        ``limit`` is a time that no lock from before the piece reaches."""
        n = len(self.ts)
        at = np.flatnonzero(np.append(True, (np.diff(self.ts) != 0) | (np.diff(self.piece) != 0))[:n])
        piece = self.piece[at]
        opens = np.append(True, np.diff(piece) != 0)[:len(at)]
        seen = np.append(False, self.ts[at][:-1] >= limit[piece[:-1]])[:len(at)]
        at = at[opens | ~seen]
        same = (np.diff(self.piece[at]) == 0) & (np.diff(self.count_after[at]) == 0) & (np.diff(self.until_after[at]) == 0)
        return at[~np.append(same, False)[:len(at)]]


def _maps(key: str, max_failures: int, lock: int):
    """Step 1: one row for each piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, border in _whole_pieces(batches, [key, _BUCKET]):
            first = border[:-1]
            walk = _Walk(_micros(t.column("ts")), np.asarray(t.column("ok")), border, max_failures, lock)
            steps = walk.steps(_micros(t.column(_BUCKET))[first] + lock)
            cut = pa.array(np.searchsorted(steps, border), pa.int32())
            counts = [walk.through(c) for c in range(max_failures)]
            rows = pa.array(np.arange(len(first) + 1) * max_failures, pa.int32())
            many = lambda offsets, values: pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                t.column(key).combine_chunks().take(pa.array(first)), t.column(_BUCKET).combine_chunks().take(pa.array(first)), pa.array(walk.ts[first]),
                many(rows, np.stack([c for c, _ in counts], axis=1).ravel()), many(rows, np.stack([u for _, u in counts], axis=1).ravel()),
                many(cut, walk.ts[steps]), many(cut, walk.count_after[steps]), many(cut, walk.until_after[steps])],
                names=[key, _BUCKET, "first", "counts", "untils", "step_ts", "step_counts", "step_untils"])
    return run


def _compose(key: str):
    """Step 2: the state that each piece begins with, from rows in (key, bucket) order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, until = None, 0, NONE
        for b in batches:
            column = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            out_count, out_until = [], []
            rows = zip(*(column[c].to_pylist() for c in (key, "first", "counts", "untils", "step_ts", "step_counts", "step_untils")), strict=True)
            for k, first, counts, untils, step_ts, step_counts, step_untils in rows:
                if k != now:
                    now, count, until = k, 0, NONE
                out_count.append(count)
                out_until.append(until)
                if until <= first:
                    # No lock, or one that ended before: its count is 0.
                    count, until = counts[count], untils[count]
                    continue
                at = bisect_left(step_ts, until)
                if at < len(step_ts):
                    count, until = step_counts[at], step_untils[at]
            yield pa.RecordBatch.from_arrays([column[key], column[_BUCKET], pa.array(out_count, pa.int64()), pa.array(out_until, pa.int64())],
                                             names=[key, _BUCKET, "__count", "__until"])
    return run


def _decide(key: str, max_failures: int, lock: int):
    """Step 3: decisions of rows that carry the state of their piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, border in _whole_pieces(batches, [key, _BUCKET]):
            first, stop = border[:-1], border[1:]
            ts = _micros(t.column("ts"))
            walk = _Walk(ts, np.asarray(t.column("ok")), border, max_failures, lock)
            count, carried = np.asarray(t.column("__count"))[first], np.asarray(t.column("__until"))[first]
            locked = carried > ts[first]
            at = np.where(locked, walk.at_or_after(np.arange(len(first)), carried), first)
            some = at < stop
            at, need = at[some], max_failures - np.where(locked, 0, count)[some]
            end, until = walk.end.copy(), walk.until.copy()
            end[at], until[at], after = walk.epoch(at, need)
            starts = np.zeros(len(ts) + 1, bool)
            starts[after[after < stop[some]]] = True
            jump = np.append(np.where(walk.next < walk.stop, walk.next, len(ts)), len(ts))
            before = -1
            while (reached := int(starts.sum())) != before:
                starts[jump[starts]] = True
                starts[-1] = False
                jump, before = jump[jump], reached
            starts[at] = True
            row = np.arange(len(ts))
            begun = np.maximum.accumulate(np.where(starts[:-1], row, -1))
            early = begun < first[walk.piece]
            begun = np.where(early, row, begun)
            refused = early | (row > end[begun])
            fires = ~early & (until[begun] != NONE) & (row == end[begun])
            lock_end = np.where(early, carried[walk.piece], until[begun])
            shown = pa.array(lock_end, pa.int64(), mask=~(refused | fires)).cast(pa.timestamp("us"))
            names = [key, "ts", "ok", "seq"]
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in names), pa.array(refused), pa.array(fires), shown],
                                             names=[*names, "refused", "fires_lock", "locked_until"])
    return run


def lockout_decisions(attempts: DataFrame, key: str = "key", ts: str = "ts", ok: str = "ok", seq: str = "seq",
                      max_failures: int = 5, lock: str = "15 minutes", bucket_unit: str = "day") -> DataFrame:
    """Each attempt (key, ts, ok, seq) with ``refused``, ``fires_lock`` and ``locked_until``.

    A (key, bucket) piece must fit a task; pieces of ``bucket_unit`` are whole units of time.
    """
    spark = attempts.sparkSession
    micros = int(spark.sql(f"SELECT CAST(INTERVAL {lock} AS INTERVAL DAY TO SECOND) AS d").first().d.total_seconds() * 1_000_000)
    a = attempts.select(F.col(key), F.col(ts).cast("timestamp_ntz").alias("ts"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"), F.col(seq).alias("seq"))
    a = a.withColumn(_BUCKET, F.date_trunc(bucket_unit, "ts").cast("timestamp_ntz")).where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col(_BUCKET).isNotNull())
    # One exchange for both readings; being asked for, it is not split by the join below.
    pieces = a.repartition(key, _BUCKET)
    of = {f.name: f.dataType.simpleString() for f in a.schema}
    order = [key, _BUCKET, "ts", "seq"]
    lists = ", ".join(f"{c} array<bigint>" for c in ("counts", "untils", "step_ts", "step_counts", "step_untils"))
    maps = pieces.sortWithinPartitions(*order).mapInArrow(_maps(key, max_failures, micros), f"`{key}` {of[key]}, {_BUCKET} timestamp_ntz, first bigint, {lists}")
    states = maps.repartition(key).sortWithinPartitions(key, _BUCKET).mapInArrow(
        _compose(key), f"`{key}` {of[key]}, {_BUCKET} timestamp_ntz, __count bigint, __until bigint")
    out = pieces.join(states, [key, _BUCKET]).sortWithinPartitions(*order).mapInArrow(
        _decide(key, max_failures, micros), f"`{key}` {of[key]}, ts timestamp_ntz, ok boolean, seq {of['seq']}, refused boolean, fires_lock boolean, locked_until timestamp_ntz")
    return out.withColumnsRenamed({"ts": ts, "ok": ok, "seq": seq})


def lockout_summary(decisions: DataFrame, key: str = "key") -> DataFrame:
    return decisions.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("refused").alias("refused"),
        F.count_if("fires_lock").alias("locks"))


# ----- streaming form -----

OUT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("ok", T.BooleanType()), T.StructField("seq", T.LongType()),
    T.StructField("refused", T.BooleanType()), T.StructField("fires_lock", T.BooleanType()),
    T.StructField("locked_until", T.TimestampNTZType()),
])
#: State stores that ``transformWithState`` works with.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Waiting attempts that a key keeps beside its count, attempts in a piece of more, and those put in order at once.
FEW, PIECE, RUN = 200, 1000, 50_000


def _order(attempt: tuple) -> tuple:
    us, seq, ok = attempt
    return us, seq is not None, seq or 0, ok


class LockoutProcessor(StatefulProcessor):
    """Folds each attempt once the watermark has passed it.

    ``lock`` holds (count, lock end, last attempt folded), the earliest timer, and what
    waits (times in microseconds): ``few`` attempts, or of a key with more the
    ``pieces`` (number, first and last time), whose attempts are in ``waiting``.  A key has one
    timer for all, so calls to the state follow its batches, not its attempts.
    """

    def __init__(self, max_failures: int, lock_seconds: int, idle_seconds: int | None):
        self.max, self.lock_us, self.idle_ms = max_failures, lock_seconds * 1_000_000, None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        attempts = "array<struct<ts: bigint, seq: bigint, ok: boolean>>"
        self.waiting = handle.getMapState("waiting", "piece bigint", f"attempts {attempts}")
        self.lock = handle.getValueState(
            "lock", f"count int, until bigint, last bigint, timer bigint, number bigint, pieces array<struct<number: bigint, first: bigint, last: bigint>>, few {attempts}")

    def _state(self) -> tuple:
        count, until, last, timer, number, pieces, few = self.lock.get() or (0, None, None, None, 0, [], [])
        return count, until, last, timer, number, [tuple(p) for p in pieces], [tuple(a) for a in few]

    def handleInputRows(self, key, rows, timerValues):
        count, until, last, timer, number, pieces, few = self._state()
        each = ((r.us, r.seq, bool(r.ok)) for r in rows)
        first = None
        while run := list(islice(each, RUN)):
            run.sort(key=_order)
            first = run[0][0] if first is None else min(first, run[0][0])
            if len(few) + len(run) <= FEW:
                few += run
                continue
            for at in range(0, len(run), PIECE):
                part = run[at:at + PIECE]
                self.waiting.updateValue((number,), (part,))
                pieces.append((number, part[0][0], part[-1][0]))
                number += 1
        if first is not None:
            # A timer at t expires when the watermark reaches it; later batches bring nothing at or before that.
            if timer is None or first // 1000 + 1 < timer:
                timer = first // 1000 + 1
                self.handle.registerTimer(timer)
            self.lock.update((count, until, last, timer, number, pieces, few))
        return iter(())

    def _due(self, pieces: list[tuple], few: list[tuple], limit: int, left: list[tuple]) -> Iterator[tuple]:
        """Attempts before ``limit`` in order.  Pieces are read when their first time is reached; those with later attempts come to ``left``."""
        heap = [(_order(a), a) for a in few if a[0] < limit]
        heapify(heap)
        for number, first, last in sorted(pieces, key=lambda p: p[1]):
            if first >= limit:
                left.append((number, first, last))
                continue
            while heap and heap[0][0][0] < first:
                yield heappop(heap)[1]
            held = [tuple(a) for a in self.waiting.getValue((number,))[0]]
            for a in held:
                if first <= a[0] < limit:
                    heappush(heap, (_order(a), a))
            if last < limit:
                self.waiting.removeKey((number,))
            else:
                left.append((number, min(a[0] for a in held if a[0] >= limit), last))
        while heap:
            yield heappop(heap)[1]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        count, until, last, timer, number, pieces, few = self._state()
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        when = lambda us: datetime(1970, 1, 1) + timedelta(microseconds=us)
        decision = Row(*OUT_SCHEMA.names)
        left: list[tuple] = []
        folded = False
        for t, n, ok in self._due(pieces, few, limit, left):
            folded, last = True, t
            if until is not None and t < until:
                yield decision(key[0], when(t), ok, n, True, False, when(until))
                continue
            count, until = (0 if ok else count + 1), (None if ok else until)
            fires = count >= self.max
            if fires:
                count, until = 0, t + self.lock_us
            yield decision(key[0], when(t), ok, n, False, fires, when(until) if fires else None)
        if folded:
            few = [a for a in few if a[0] >= limit]
            first = min([p[1] for p in left] + [a[0] for a in few], default=None)
            timer = None if first is None else first // 1000 + 1
            if timer is not None:
                self.handle.registerTimer(timer)
            self.lock.update((count, until, last, timer, number, left, few))
            if self.idle_ms is not None:
                self.handle.registerTimer(self._forget(last, until))
        elif last is not None and self.idle_ms is not None and expiredTimerInfo.getExpiryTimeInMs() >= self._forget(last, until):
            if pieces or few:
                self.lock.update((0, None, None, timer, number, pieces, few))
            else:
                self.lock.clear()

    def _forget(self, last: int, until: int | None) -> int:
        return max(last, until or 0) // 1000 + 1 + self.idle_ms

    def close(self) -> None:
        pass


def lockouts_stream(attempts: DataFrame, max_failures: int = 5, lock_seconds: int = 900,
                    watermark: str = "1 hour", idle_seconds: int | None = None) -> DataFrame:
    """Streaming decisions (key, ts, ok, seq columns in).

    A decision comes when the watermark has passed its attempt, so attempts
    may arrive in any order within ``watermark``; later ones are dropped.
    Failures are kept for good, as in the source.  With
    ``idle_seconds`` a key is forgotten after that much event time without an
    attempt, counted from the end of its lock if that is later; this bounds
    the state and gives up failures older than it.  The state store is RocksDB.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    s = attempts.select("key", F.col("ts").cast("timestamp_ltz").alias("ts"), "ok", "seq").where("key IS NOT NULL")
    s = s.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    return s.groupBy("key").transformWithState(LockoutProcessor(max_failures, lock_seconds, idle_seconds), OUT_SCHEMA, "Append", "EventTime")
