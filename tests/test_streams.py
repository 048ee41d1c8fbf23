"""Sessions, lockouts and audit feed: edges, batch against brute force, and
stream against batch."""

import datetime as dt
import os
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from wrenchpark.streaming import audit_feed, lockouts, sessions

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def _ts(minutes, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def brute_lockouts(rows, max_failures, lock):
    """Straight fold of the source rule, per key in time order."""
    out = {}
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for key, rs in by_key.items():
        count, until = 0, None
        for k, ts, ok, seq in sorted(rs, key=lambda r: (r[1], r[3])):
            if until is not None and ts < until:
                out[seq] = (True, False)
                continue
            if ok:
                count, until = 0, None
                out[seq] = (False, False)
            else:
                count += 1
                if count >= max_failures:
                    until, count = ts + lock, 0
                    out[seq] = (False, True)
                else:
                    out[seq] = (False, False)
    return out


def test_session_gap_edges(spark):
    rows = [(1, _ts(0)), (1, _ts(30)), (1, _ts(60, 1)), (2, _ts(0)), (2, _ts(0, 1))]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    got = sorted((r.user_id, r.n_events) for r in sessions.sessions(df, gap="30 minutes").collect())
    # exactly 30 minutes keeps the session; 30 minutes and 1 second starts a new one
    assert got == [(1, 1), (1, 2), (2, 2)]


def test_sessions_across_buckets(spark):
    random.seed(7)
    rows = []
    for u in range(5):
        t = T0
        for _ in range(300):
            t += dt.timedelta(minutes=random.choice([1, 5, 29, 30, 31, 90, 600]))
            rows.append((u, t))
    df = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz")
    expect = []
    for u in range(5):
        ts = sorted(t for uu, t in rows if uu == u)
        start = prev = ts[0]
        n = 1
        for t in ts[1:]:
            if t - prev > dt.timedelta(minutes=30):
                expect.append((u, start, prev, n))
                start, n = t, 0
            n += 1
            prev = t
        expect.append((u, start, prev, n))
    for unit in ("hour", "day"):
        got = sorted((r.user_id, r.session_start, r.session_end, r.n_events)
                     for r in sessions.sessions(df, gap="30 minutes", bucket_unit=unit).collect())
        assert got == sorted(expect)


def test_lockout_edges(spark):
    f = lambda m, s=0: _ts(m, s)
    rows = [
        # fifth failure locks; attempts inside the lock are refused, success too
        ("a", f(0), False, 1), ("a", f(1), False, 2), ("a", f(2), False, 3), ("a", f(3), False, 4),
        ("a", f(4), False, 5), ("a", f(5), True, 6), ("a", f(10), False, 7),
        # attempt exactly at lock end (4 + 15 = 19) is accepted
        ("a", f(19), False, 8),
        # success after four failures clears the count
        ("b", f(0), False, 1), ("b", f(1), False, 2), ("b", f(2), False, 3), ("b", f(3), False, 4),
        ("b", f(4), True, 5), ("b", f(5), False, 6),
    ]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ok boolean, seq long")
    d = {(r.key, r.seq): (r.refused, r.fires_lock)
         for r in lockouts.lockout_decisions(df, max_failures=5, lock="15 minutes").collect()}
    _check_edges(d)


def _check_edges(d):
    assert d[("a", 5)] == (False, True)
    assert d[("a", 6)] == (True, False) and d[("a", 7)] == (True, False)
    assert d[("a", 8)] == (False, False)
    assert all(not v[0] and not v[1] for k, v in d.items() if k[0] == "b")


def test_lockouts_against_fold(spark):
    random.seed(11)
    rows = []
    seq = 0
    for key in ["k1", "k2", "k3"]:
        t = T0
        for _ in range(400):
            t += dt.timedelta(minutes=random.choice([0, 1, 2, 7, 15, 16, 40]))
            seq += 1
            rows.append((key, t, random.random() < 0.2, seq))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ok boolean, seq long")
    expect = brute_lockouts(rows, 3, dt.timedelta(minutes=15))
    got = {r.seq: (r.refused, r.fires_lock)
           for r in lockouts.lockout_decisions(df, max_failures=3, lock="15 minutes", bucket_unit="hour").collect()}
    assert got == expect


def test_lockouts_on_driver_tables(spark):
    from wrenchpark.sources.testdata import DriverModel
    m = DriverModel(spark, "/root/testdata/sf0.01")
    d = lockouts.lockout_decisions(m.login_attempts, max_failures=3, lock="12 hours")
    s = d.agg(F.count_if("fires_lock").alias("locks"), F.count_if("refused").alias("refused")).first()
    assert (s.locks, s.refused) == (270, 110)


def _run_lockouts(spark, scratch, name, batches, **kw):
    """One file, and so one micro-batch, for each list of rows."""
    src = os.path.join(scratch, f"{name}_src")
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ok boolean, seq long").coalesce(1)
        part.write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.endswith(".parquet") and not f.startswith("b"):
                os.rename(os.path.join(src, f), os.path.join(src, f"b{i:03d}.parquet"))
                os.utime(os.path.join(src, f"b{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = (spark.readStream.schema("key string, ts timestamp_ntz, ok boolean, seq long")
              .option("maxFilesPerTrigger", 1).parquet(src))
    q = (lockouts.lockouts_stream(stream, **kw).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, f"{name}_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return {r.seq: (r.refused, r.fires_lock) for r in spark.sql(f"SELECT * FROM {name}").collect()}


def test_lockouts_stream_matches_batch(spark, scratch):
    random.seed(3)
    rows = []
    seq = 0
    for key in ["x", "y"]:
        t = T0
        for _ in range(60):
            t += dt.timedelta(minutes=random.choice([1, 3, 20]))
            seq += 1
            rows.append((key, t, random.random() < 0.25, seq))
    # Batches by time, each shuffled, with attempts that come up to 50 minutes late; the last row moves the watermark past all.
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=random.choice([0, 0, 50])))
    batches = [random.sample(arrival[i:i + 30], len(arrival[i:i + 30])) for i in range(0, len(arrival), 30)]
    batches.append([("z", T0 + dt.timedelta(days=9), True, 0)])
    got = _run_lockouts(spark, scratch, "lock_out", batches, max_failures=3, lock_seconds=900)
    assert {s: v for s, v in got.items() if s} == brute_lockouts(rows, 3, dt.timedelta(minutes=15))


def test_lockouts_stream_keeps_silent_keys(spark, scratch):
    a = [("a", _ts(0), False, 1), ("a", _ts(1), False, 2), ("a", _ts(60 * 50), False, 3), ("a", _ts(60 * 50 + 1), True, 4)]
    far = [[("b", _ts(60 * h), True, 100 + h)] for h in (10, 20, 30)]
    end = [("b", _ts(60 * 200), True, 200)]
    batches = [a[:2], *far, a[2:], end]
    got = _run_lockouts(spark, scratch, "lock_silent", batches, max_failures=3, lock_seconds=900)
    assert got[3] == (False, True) and got[4] == (True, False)
    # With an idle limit the key is forgotten on purpose.
    got = _run_lockouts(spark, scratch, "lock_idle", batches, max_failures=3, lock_seconds=900, idle_seconds=3600)
    assert got[3] == (False, False) and got[4] == (False, False)


def test_sessions_stream_matches_batch(spark, scratch):
    rows = [(1, _ts(0)), (1, _ts(30)), (1, _ts(61)), (2, _ts(5)), (2, _ts(200)),
            (9, _ts(60 * 24))]   # closing row moves the watermark past every session
    src = os.path.join(scratch, "act_src")
    spark.createDataFrame(rows, "user_id int, ts timestamp_ntz").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("user_id int, ts timestamp_ntz").parquet(src)
    q = (sessions.sessions_stream(stream, gap="30 minutes", watermark="1 hour")
         .writeStream.format("memory").queryName("sess_out").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "sess_ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.user_id, r.session_start, r.n_events) for r in spark.sql("SELECT * FROM sess_out").collect())
    batch = sorted((r.user_id, r.session_start, r.n_events)
                   for r in sessions.sessions(spark.createDataFrame(rows[:-1], "user_id int, ts timestamp_ntz"),
                                              gap="30 minutes").collect())
    assert got == batch


def test_audit_daily_stream_drops_replays(spark, scratch):
    rows = [(1, "CREADO", T0), (2, "EDITADO", T0 + dt.timedelta(hours=1)), (2, "EDITADO", T0 + dt.timedelta(hours=1)),
            (3, "CREADO", T0 + dt.timedelta(days=1)), (4, "CREADO", T0 + dt.timedelta(days=3))]
    src = os.path.join(scratch, "audit_src")
    spark.createDataFrame(rows, "id long, action string, logged_at timestamp_ntz").write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema("id long, action string, logged_at timestamp_ntz").parquet(src)
    q = (audit_feed.daily_counts_stream(stream).writeStream.format("memory").queryName("audit_out")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "audit_ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((str(r.day), r.action, r.n) for r in spark.sql("SELECT * FROM audit_out").collect())
    assert got == [("2024-01-01", "CREADO", 1), ("2024-01-01", "EDITADO", 1), ("2024-01-02", "CREADO", 1)]


def test_stream_job_writes_parquet(spark, scratch):
    from wrenchpark.streaming import jobs
    rows = [(1, _ts(0)), (1, _ts(20)), (1, _ts(120)), (5, _ts(60 * 30))]
    src = os.path.join(scratch, "job_src")
    spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz").write.mode("overwrite").parquet(src)
    out, ck = os.path.join(scratch, "job_out"), os.path.join(scratch, "job_ckpt")
    jobs.run_sessions(spark, src, out, ck, available_now=True).awaitTermination()
    got = sorted((r.user_id, r.n_events) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (1, 2)]


def test_jobs_table_layout(spark, scratch):
    from wrenchpark.sources.sinks import write_jobs_table
    from wrenchpark.sources.testdata import DriverModel
    m = DriverModel(spark, "/root/testdata/sf0.001")
    out = os.path.join(scratch, "jobs_table")
    write_jobs_table(m.jobs, out)
    back = spark.read.parquet(out)
    assert back.count() == m.jobs.count()
    plan = back.where(F.col("created_month") == "1998-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan


def test_expired_sessions_strictly_after_idle_limit(spark):
    rows = [(1, _ts(0)), (2, _ts(29, 59)), (3, _ts(30)), (4, _ts(30, 1))]
    df = spark.createDataFrame(rows, "user_id int, last_activity timestamp_ntz")
    now = str(_ts(60))
    got = sorted(r.user_id for r in sessions.expired(df, now, idle="30 minutes").collect())
    # idle 60 min, 30 min 1 s -> expired; exactly 30 min or less -> still active
    assert got == [1, 2]


class _Value:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def get(self):
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None


class _Map(dict):
    def __init__(self, calls):
        self.calls = calls

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.calls.append("piece")
        self[key] = value

    def removeKey(self, key):
        del self[key]


class _Handle:
    """State of one key, in order of time."""

    def __init__(self):
        self.calls, self.timers = [], set()

    def getMapState(self, *_):
        return _Map(self.calls)

    def getValueState(self, *_):
        return _Value(self.calls)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)


def _fold(handle, processor, batches, watermarks):
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    out = []
    for rows, mark in zip(batches, watermarks, strict=True):
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: us(mark) // 1000)
        if rows:
            list(processor.handleInputRows(("k",), iter([SimpleNamespace(us=us(t), seq=seq, ok=ok) for _, t, ok, seq in rows]), values))
        for at in sorted(x for x in handle.timers if x <= us(mark) // 1000):
            out += processor.handleExpiredTimer(("k",), values, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
            handle.timers.discard(at)
    return out


def test_lockouts_stream_calls_follow_batches(monkeypatch):
    rng = random.Random(12)
    rows = [("k", T0 + dt.timedelta(microseconds=rng.randrange(10**10)), rng.random() < 0.3, i) for i in range(1000)]
    rows += [("k", r[1], not r[2], 1000 + r[3]) for r in rows[::10]]
    rows.sort(key=lambda r: r[1])
    want = brute_lockouts(rows, 3, dt.timedelta(seconds=30))
    for few, piece, run in ((10**6, 1000, 10**6), (5, 7, 60), (40, 1000, 10)):
        monkeypatch.setattr(lockouts, "FEW", few)
        monkeypatch.setattr(lockouts, "PIECE", piece)
        monkeypatch.setattr(lockouts, "RUN", run)
        batches, marks = [], []
        for at in range(0, len(rows), 100):
            # Each batch mixes its rows, and its watermark stays behind the next batch.
            batches.append(rng.sample(rows[at:at + 100], len(rows[at:at + 100])))
            marks.append(min(r[1] for r in rows[at + 50:]) if at else T0)
        # Rows of a batch at or before the watermark of the batch before would be late.
        late = [r for b, m in zip(batches[1:], marks, strict=False) for r in b if r[1] <= m]
        assert not late
        handle = _Handle()
        processor = lockouts.LockoutProcessor(3, 30, None)
        processor.init(handle)
        out = _fold(handle, processor, [*batches, []], [*marks, T0 + dt.timedelta(days=9)])
        assert {r.seq: (r.refused, r.fires_lock) for r in out} == want and len(out) == len(rows)
        assert [(r.ts, r.seq) for r in out] == sorted((r[1], r[3]) for r in rows)
        assert not processor.waiting and not processor.lock.value[5] and not processor.lock.value[6]
        if few > 1000:
            assert len(handle.calls) <= 6 * len(batches)
