"""One key with a third of all rows: results stay exact and the ordered
scans split the hot key over its time buckets."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wrenchpark.operators.ordered import scan
from wrenchpark.streaming import lockouts, sessions
from test_streams import brute_lockouts

T0 = dt.datetime(2024, 1, 1)


def _events(n_hot=3000, n_cold=20, cold_keys=300):
    random.seed(5)
    rows = []
    t = T0
    for i in range(n_hot):                                  # the hot key: a third of all rows
        t += dt.timedelta(minutes=random.choice([1, 2, 20, 45]))
        rows.append(("hot", t, random.random() < 0.1, i))
    seq = n_hot
    for k in range(cold_keys):
        t = T0
        for _ in range(n_cold):
            t += dt.timedelta(hours=random.choice([1, 5, 30]))
            seq += 1
            rows.append((f"k{k}", t, random.random() < 0.3, seq))
    return rows


def test_hot_key_is_split_by_buckets(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ok boolean, seq long")
    total = df.count()
    hot = df.where(F.col("key") == "hot").count()
    assert hot * 3 >= total - 100
    biggest = df.groupBy("key", F.date_trunc("day", "ts")).count().agg(F.max("count")).first()[0]
    assert biggest < hot / 20                               # no window partition holds the hot key
    out = scan(df.withColumn("one", F.lit(1)), "key", ["ts", "seq"], F.date_trunc("day", "ts"),
               previous=["seq"], running=["one"])
    hot_rows = sorted((r.run_one, r.prev_seq, r.seq) for r in out.where(F.col("key") == "hot").collect())
    assert [r[0] for r in hot_rows] == list(range(1, hot + 1))
    assert all(p == s - 1 for _, p, s in hot_rows[1:])


def test_hot_key_lockouts_exact(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ok boolean, seq long")
    got = {r.seq: (r.refused, r.fires_lock)
           for r in lockouts.lockout_decisions(df, max_failures=5, lock="15 minutes").collect()}
    assert got == brute_lockouts(rows, 5, dt.timedelta(minutes=15))


def test_hot_key_sessions_exact(spark):
    rows = _events()
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "user_id string, ts timestamp_ntz")
    got = sorted((r.user_id, r.session_start, r.n_events)
                 for r in sessions.sessions(df, gap="30 minutes").collect())
    expect = []
    for key in sorted({r[0] for r in rows}):
        ts = sorted(r[1] for r in rows if r[0] == key)
        start, prev, n = ts[0], ts[0], 1
        for t in ts[1:]:
            if t - prev > dt.timedelta(minutes=30):
                expect.append((key, start, n))
                start, n = t, 0
            n += 1
            prev = t
        expect.append((key, start, n))
    assert got == sorted(expect)


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_ordered_scans_read_their_input_once(spark):
    from conftest import SF_CHECK
    from wrenchpark.plans import registry
    for key, column in (("status_history", "event_type"), ("audit_rows", "event_type"), ("sessions", "user_id")):
        plan = _executed(registry.queries()[key](spark, SF_CHECK))
        scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and column in ln]
        assert len(scans) == 1 and "ReusedExchange" in plan, key


def test_one_key_on_one_day_is_split(spark):
    from wrenchpark.operators import changes as C
    from wrenchpark.operators.dims import Dim
    n = 2400
    changes = spark.createDataFrame([(1, 1 + i % 3, T0 + dt.timedelta(seconds=36 * i), i) for i in range(n)],
                                    "job_id long, status_id int, ts timestamp_ntz, seq long")
    jobs = spark.createDataFrame([(1, 4)], "id long, status_id int")
    statuses = Dim(spark.createDataFrame([(1, "Pendiente"), (2, "En curso"), (3, "Cerrado"), (4, "En espera")], "id int, name string"), 4)
    got = sorted((r.seq, r.from_status, r.to_status) for r in C.status_history(jobs, changes, statuses).collect())
    assert got == [(i, 1 + (i - 1) % 3 if i else 4, 1 + i % 3) for i in range(n)]
    pieces = changes.groupBy("job_id", F.date_trunc("hour", "ts")).count().agg(F.max("count")).first()[0]
    assert pieces == 100                                    # one day of one job is 24 pieces
    day = changes.select(F.col("job_id").alias("user_id"), "ts")
    assert [r.n_events for r in sessions.sessions(day).collect()] == [n]


def test_lockouts_of_many_shapes(spark):
    """Locks shorter and longer than the buckets, ties in time, any number of failures: all equal to the straight fold."""
    random.seed(9)
    rows, seq = [], 0
    for k in range(12):
        t = T0 + dt.timedelta(minutes=random.randint(0, 5000))
        for _ in range(120):
            t += dt.timedelta(minutes=random.choice([0, 0, 1, 3, 59, 60, 61, 700, 3000]), microseconds=random.choice([0, 1]))
            seq += 1
            rows.append((f"k{k}", t, random.random() < 0.15, seq))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, ok boolean, seq long")
    for most, lock, hours, unit in ((1, "1 hour", 1, "hour"), (2, "3 days", 72, "hour"), (3, "40 hours", 40, "day"), (4, "1 hour", 1, "month"), (7, "2 hours", 2, "day")):
        got = lockouts.lockout_decisions(df, max_failures=most, lock=lock, bucket_unit=unit).collect()
        expect = brute_lockouts(rows, most, dt.timedelta(hours=hours))
        assert {r.seq: (r.refused, r.fires_lock) for r in got} == expect, (most, lock, unit)
        ends = {r.seq: r.ts + dt.timedelta(hours=hours) for r in got if r.fires_lock}
        assert all(r.locked_until in ends.values() if r.refused or r.fires_lock else r.locked_until is None for r in got)


def test_lockouts_of_rows_without_key_time_or_outcome(spark):
    rows = [("a", T0, None, 1), ("a", T0, None, 2), (None, T0, False, 3), ("a", None, False, 4), ("a", T0 + dt.timedelta(minutes=1), True, 5), ("b", T0, True, 6)]
    df = spark.createDataFrame(rows, "who string, at timestamp_ntz, ok boolean, n long").withColumn("counts", F.lit(1)).withColumn("first", F.lit(1))
    got = {r.n: (r.refused, r.fires_lock) for r in lockouts.lockout_decisions(df, "who", "at", "ok", "n", max_failures=2, lock="1 hour").collect()}
    assert got == {1: (False, False), 2: (False, True), 5: (True, False), 6: (False, False)}
    assert lockouts.lockout_decisions(df.limit(0), "who", "at", "ok", "n").count() == 0


def test_lockouts_read_their_input_once_and_join_only_states(spark):
    from conftest import SF_CHECK
    from wrenchpark.plans import registry
    plan = _executed(registry.queries()["lockouts_hot"](spark, SF_CHECK))
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    assert sum(x in line for line in plan.splitlines() for x in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin")) == 1
    assert "ExistingRDD" not in plan                        # no checkpoint on the way


def test_compose_carries_states_over_empty_and_locked_pieces():
    import numpy as np
    us = lambda m: int((T0 + dt.timedelta(minutes=m) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    # Three failures lock for two hours; pieces of an hour.
    at = [0, 1, 2, 70, 122, 130, 131, 200]
    ts, border = np.array([us(m) for m in at]), np.array([0, 3, 4, 7, 8])
    walk = lockouts._Walk(ts, np.zeros(8, bool), border, 3, 120 * 60 * 10**6)
    assert [c.tolist() for c, _ in (walk.through(0), walk.through(2))] == [[0, 1, 0, 1], [0, 0, 0, 0]]
    assert walk.through(2)[1].tolist() == [us(120), us(190), us(242), us(320)]
    until = walk.through(0)[1]
    assert until.tolist() == [us(122), lockouts.NONE, us(251), lockouts.NONE]
    steps = walk.steps(np.array([us(120), us(180), us(240), us(300)]))
    assert steps.tolist() == [0, 1, 2, 3, 4, 5, 6, 7]
