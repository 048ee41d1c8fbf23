"""Scalar helpers (X1-X27), optional tables (S2), drift (S5), manifest (S11)."""

import datetime as dt
import os

from pyspark.sql import functions as F

from wrenchpark import schema as S
from wrenchpark.functions import text as TX
from wrenchpark.functions import timefmt as TF
from wrenchpark.operators import attachments as A
from wrenchpark.operators.listing import status_bucket
from wrenchpark.sources.tables import conform, optional_table


def _one(spark, col, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first().r


def test_text_helpers(spark):
    df = spark.createDataFrame([(" ﻿  hola  \n",), ("   ",), (None,)], "x string")
    got = [r.r for r in df.select(TX.trim_to_null("x").alias("r")).collect()]
    assert got == ["hola", None, None]
    assert _one(spark, TX.provider_key("x", "—"), value="  ACME  ") == "ACME"
    assert _one(spark, TX.provider_key("x", "—"), value="  ") == "—"
    assert _one(spark, TX.first_forwarded("x"), value=" 10.0.0.1 , 10.0.0.2") == "10.0.0.1"
    assert _one(spark, TX.cut("x", 250), value="a" * 300) == "a" * 250


def test_time_helpers(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 0), dt.datetime(2024, 1, 2, 1, 0))],
                                "a timestamp_ntz, b timestamp_ntz").select(
        TF.midnights_between("a", "b").alias("m"), TF.fmt_ts("a").alias("f"),
        TF.days_open("a", TF.ts_lit("2024-01-03 22:59:59")).alias("d"),
        TF.days_open("b", TF.ts_lit("2023-12-01 00:00:00")).alias("neg"),
        TF.js_round(F.lit(-2.5)).alias("r1"), TF.js_round(F.lit(2.5)).alias("r2"),
        TF.parse_ts(F.lit("2024-02-30 10:00:00")).alias("bad"),
        *[c.alias(n) for c, n in zip(TF.day_bounds("a"), ["s", "e"])]).first()
    assert (row.m, row.f, row.d, row.neg, row.r1, row.r2, row.bad) == (1, "2024-01-01 23:00:00", 1, 0, -2, 3, None)
    assert (row.s, row.e) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 23, 59, 59))
    assert TF.day_end("2024-01-01") == "2024-01-01 23:59:59"


def test_status_bucket(spark):
    df = spark.createDataFrame([("Cerrado",), ("EN CURSO",), ("en_curso",), ("Pendiente",), ("En espera",)], "s string")
    assert [r.b for r in df.select(status_bucket("s").alias("b")).collect()] == \
        ["closed", "in_progress", "in_progress", "pending", "other"]


def test_paths(spark):
    df = spark.createDataFrame([(7, dt.datetime(2024, 3, 5, 14, 7, 9), "image/png", "seed")],
                               "job long, t timestamp_ntz, mime string, seed string")
    p = df.select(A.storage_path("job", "t", "mime", "seed").alias("p")).first().p
    assert p.startswith("/uploads/2024-03/7_20240305_140709_") and p.endswith(".png") and len(p.split("_")[-1]) == 16
    assert _one(spark, A.extension("x"), value="application/pdf") == "bin"
    assert _one(spark, A.safe_relative("x"), value="\\uploads\\2024-03\\a.png") == "2024-03/a.png"
    assert _one(spark, A.safe_relative("x"), value="/etc/passwd") is None


def test_optional_table_and_drift(spark, scratch):
    missing = optional_table(spark, os.path.join(scratch, "nope.parquet"), S.CATALOG)
    assert missing.count() == 0 and missing.schema == S.CATALOG
    path = os.path.join(scratch, "prio.parquet")
    spark.createDataFrame(S.PRIORITY_SEED, S.CATALOG).write.mode("overwrite").parquet(path)
    assert optional_table(spark, path, S.CATALOG).count() == 3
    old = spark.createDataFrame([(1, 5, "antes", "/uploads/a.png")], "id long, trabajo long, tipo_adjunto string, file_path string")
    c = conform(old, S.ATTACHMENT, aliases={"group": ["tipo_adjunto", "tipo"], "job_id": ["trabajo"]}).first()
    assert (c.group, c.job_id, c.original_name, c.uploaded_at) == ("antes", 5, None, None)


def test_manifest_feeds_checks(spark, scratch):
    d = os.path.join(scratch, "uploads")
    os.makedirs(d, exist_ok=True)
    for name, size in [("a.png", 10), ("b.png", 20), ("c.png", 30)]:
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(b"x" * size)
    m = A.manifest(spark, d, "*.png")
    files = m.select(F.lit(1).alias("upload_id"), F.lit("antes").alias("group"),
                     F.lit("image/png").alias("mime_type"), F.col("length").alias("size_bytes"))
    out = A.check_uploads(files, max_bytes=25).select("accepted", "reason").distinct().collect()
    assert [(r.accepted, r.reason) for r in out] == [(False, "count:antes,size")]


def test_local_now_is_wall_clock_of_zone(spark):
    row = spark.range(1).select(TF.local_now().alias("s"), TF.local_now("UTC").alias("u")).first()
    assert isinstance(row.s, dt.datetime) and row.s.tzinfo is None
    # Santiago is 3 or 4 hours behind UTC
    assert dt.timedelta(hours=2) < row.u - row.s < dt.timedelta(hours=5)
