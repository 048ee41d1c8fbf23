"""Public helpers not covered elsewhere: one-pass validation output, report
JSON, not-found detail, SQL views, keyset pages."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from wrenchpark.operators import ingest as I
from wrenchpark.operators import listing as L
from wrenchpark.operators import reports as R
from wrenchpark.operators.filters import JobFilter
from wrenchpark.sources.testdata import DriverModel


def test_write_validated_splits_once(spark, scratch):
    m = DriverModel(spark, SF_SMALL)
    out = os.path.join(scratch, "validated")
    I.write_validated(m.incoming, out)
    back = spark.read.parquet(out)
    v = I.validate(m.incoming)
    assert back.where("outcome = 'accepted'").count() == I.accepted(v).count()
    assert back.where("outcome = 'rejected'").count() == I.rejected(v).count()
    assert back.count() == m.incoming.count()


def test_report_json_round_trip(spark):
    m = DriverModel(spark, SF_SMALL)
    doc = R.report_document(m.jobs, m.catalogs(), JobFilter.for_report(date_from="1998-01-01",
                                                                       date_to="1998-12-31"), "1998-12-31")
    js = json.loads(R.report_json(doc).first().report)
    assert js["range"] == {"from": "1998-01-01", "to": "1998-12-31"}
    assert js["kpis"]["total"] == sum(x["total"] for x in js["by_status"])
    assert len(js["top_providers"]) <= 10
    amounts = [float(p["amount"]) for p in js["top_providers"]]
    assert amounts == sorted(amounts, reverse=True)


def test_detail_not_found_and_found(spark):
    m = DriverModel(spark, SF_SMALL)
    assert L.job_detail(m.jobs, m.catalogs(), m.attachments, 10 ** 9).count() == 0
    row = L.job_detail(m.jobs, m.catalogs(), m.attachments, 7).first()
    ids = [a.id for a in row.attachments]
    assert ids == sorted(ids, reverse=True) and row.status_name is not None


def test_sql_views(spark):
    m = DriverModel(spark, SF_SMALL)
    m.register_views(prefix="wp_")
    n = spark.sql("SELECT count(*) AS n FROM wp_jobs j JOIN wp_statuses s ON s.id = j.status_id").first().n
    assert n == m.jobs.count()


def test_keyset_page_follows_offset_page(spark):
    m = DriverModel(spark, SF_SMALL)
    rows = L.star(m.jobs, m.catalogs())
    first = L.list_page(rows, page=1, page_size=20).collect()
    second = L.list_page(rows, page=2, page_size=20).select("id").collect()
    last = first[-1]
    keyset = L.after_cursor(rows, str(last.created_at), last.id, 20).select("id").collect()
    assert [r.id for r in keyset] == [r.id for r in second]
