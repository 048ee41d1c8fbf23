"""Change batches on literal frames: unknown job, unknown status, close then
reopen, two changes at one time, full updates, deletes and cascades."""

import datetime as dt

from pyspark.sql import functions as F

from wrenchpark import schema as S
from wrenchpark.operators import audit as AU
from wrenchpark.operators import changes as C
from wrenchpark.operators import ingest as I
from wrenchpark.operators.dims import Dim

T0 = dt.datetime(2024, 5, 1, 9, 0, 0)


def _jobs(spark):
    rows = [(1, T0, 1, None, "a"), (2, T0, 3, T0 + dt.timedelta(days=1), "b"), (3, T0, 2, None, "c")]
    return spark.createDataFrame(rows, "id long, created_at timestamp_ntz, status_id int, closed_at timestamp_ntz, "
                                       "description string")


def _statuses(spark):
    return Dim(spark.createDataFrame(S.STATUS_SEED, S.CATALOG), len(S.STATUS_SEED))


def test_status_changes(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    changes = spark.createDataFrame([
        (1, 3, h(1), 1),      # close ...
        (1, 2, h(2), 2),      # ... then reopen: closed_at cleared
        (2, 1, h(3), 3), (2, 3, h(3), 4),   # two changes at one time: seq decides
        (3, 99, h(1), 5),     # unknown status: rejected, job untouched
        (7, 1, h(1), 6),      # unknown job
        (3, 0, h(2), 7),      # no status
    ], "job_id long, status_id int, ts timestamp_ntz, seq long")
    snap = {r.id: (r.status_id, r.closed_at) for r in C.apply_status_changes(_jobs(spark), changes, _statuses(spark)).collect()}
    assert snap == {1: (2, None), 2: (3, h(3)), 3: (2, None)}
    _, rej = C.valid_status_changes(_jobs(spark), changes, _statuses(spark))
    assert sorted((r.seq, r.reason) for r in rej.collect()) == [(5, "fk:estado"), (6, "not_found"), (7, "invalid")]
    hist = sorted((r.seq, r.from_status, r.to_status, r.closed)
                  for r in C.status_history(_jobs(spark), changes, _statuses(spark)).collect())
    assert hist == [(1, 1, 3, True), (2, 3, 2, False), (3, 3, 1, False), (4, 1, 3, True)]
    audit = {r.seq: r.detail for r in AU.audit_from_history(C.status_history(_jobs(spark), changes, _statuses(spark))).collect()}
    assert audit[1] == '{"from":1,"to":3,"cerrado":true}'


def test_changes_one_by_one_equal_batch(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [(1, 3, h(1), 1), (3, 3, h(2), 2), (1, 4, h(3), 3), (2, 2, h(4), 4)]
    schema = "job_id long, status_id int, ts timestamp_ntz, seq long"
    batch = C.apply_status_changes(_jobs(spark), spark.createDataFrame(rows, schema), _statuses(spark))
    step = _jobs(spark)
    for r in rows:
        step = C.apply_status_changes(step, spark.createDataFrame([r], schema), _statuses(spark))
    key = lambda df: sorted((r.id, r.status_id, r.closed_at) for r in df.collect())
    assert key(batch) == key(step)


def test_full_update_replaces_row(spark):
    jobs = spark.createDataFrame([(1, T0, None, "old", 5, 1, 1, "x@y.cl", T0)],
                                 "id long, created_at timestamp_ntz, priority_id int, description string, "
                                 "location_id int, type_id int, status_id int, owner_email string, closed_at timestamp_ntz")
    for c in C.UPDATE_COLUMNS:
        if c not in jobs.columns:
            jobs = jobs.withColumn(c, F.lit(None).cast("string"))
    upd = spark.createDataFrame([(1, 1, "first", "4", "2", "3"), (1, 2, "second", "6", "2", "3"),
                                 (9, 3, "nobody", "1", "1", "1")],
                                "target_id long, seq long, description string, location_id string, type_id string, "
                                "status_id string")
    valid = I.accepted(I.validate(upd, mode="update"))
    snap, nf = C.apply_updates(jobs, valid)
    r = snap.first()
    assert (r.description, r.location_id, r.owner_email, r.created_at, r.closed_at) == ("second", 6, None, T0, T0)
    assert [x.target_id for x in nf.collect()] == [9]


def test_deletes_and_cascade(spark):
    comments = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, job_id long")
    left, nf = C.delete_rows(comments, spark.createDataFrame([(11,), (99,)], "id long"))
    assert sorted(r.id for r in left.collect()) == [10, 12] and [r.id for r in nf.collect()] == [99]
    kids = C.cascade_delete({"comments": comments}, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in kids["comments"].collect()] == [12]


def test_comment_intake(spark):
    jobs = _jobs(spark)
    inc = spark.createDataFrame([(1, "  hola  "), (1, "   "), (9, "x"), (2, "y" * 300)], "job_id long, comment string")
    acc, rej = I.comments_split(inc, jobs)
    got = sorted((r.job_id, r.comment, len(r.preview)) for r in acc.collect())
    assert got == [(1, "hola", 4), (2, "y" * 300, 200)]
    assert sorted((r.job_id, r.reason) for r in rej.collect()) == [(1, "empty"), (9, "not_found")]


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 13).select((F.col("id") * 7 % 5000).alias("rid"))
    out = I.assign_ids(df, ["rid"], base=100)
    rows = sorted((r.rid, r.id) for r in out.collect())
    assert [i for _, i in rows] == list(range(101, 5101))


def test_audit_details(spark):
    jobs = spark.createDataFrame([(5, 2, 7, None, dt.date(2024, 6, 1), T0)],
                                 "id long, type_id int, location_id int, priority_id int, due_date date, "
                                 "created_at timestamp_ntz")
    assert AU.audit_created(jobs).first().detail == \
        '{"tipo_id":2,"ubicacion_id":7,"prioridad_id":null,"fecha_objetivo":"2024-06-01"}'
    files = spark.createDataFrame([(5,), (5,), (6,)], "job_id long")
    assert sorted((r.job_id, r.detail) for r in AU.audit_uploaded(files).collect()) == \
        [(5, '{"count":2}'), (6, '{"count":1}')]
    upd = spark.createDataFrame([(5, "x" * 250)], "target_id long, description string")
    assert len(AU.audit_edited(upd).first().detail) == len('{"descripcion":""}') + 200
    gone = spark.createDataFrame([(11, 5)], "id long, job_id long")
    assert AU.audit_deleted(gone, "comment").first().detail == '{"comentario_id":11}'
    assert AU.audit_deleted(gone, "attachment").first().action == "ADJUNTO_ELIMINADO"
    req = spark.createDataFrame([(5, "1.2.3.4, 5.6.7.8", "ua" * 200)], "job_id long, xff string, ua string")
    r = AU.with_request(req, forwarded_for="xff", user_agent="ua", actor_name="Ana").first()
    assert (r.ip, len(r.user_agent), r.actor_name) == ("1.2.3.4", 250, "Ana")
