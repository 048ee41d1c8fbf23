"""Every registered key against its DuckDB twin (sf0.001: fast, whole tables)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from wrenchpark.plans import registry
from conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_key_has_an_oracle():
    # The training-data queries, present only with their subpackage, have tests of their own.
    assert set(registry.oracle_sql()) == set(registry.queries()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["provider", "total", "amount"]
    assert 0 < df.count() <= 10


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_key_matches_duckdb(spark, con, key):
    df = registry.queries()[key](spark, SF_SMALL)
    cols = df.columns
    rows = df.collect()
    cur = con.execute(registry.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    a = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in rows)
    idx = {c: i for i, c in enumerate(ocols)}
    b = sorted(tuple(_norm(r[idx[c]]) for c in sorted(cols)) for r in orows)
    assert a == b
