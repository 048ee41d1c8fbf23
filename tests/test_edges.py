"""Edge cases the synthetic tables lack (FIXTURES.md section 4)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wrenchpark.functions.search import like_to_regex, search_predicate
from wrenchpark.operators import exports as X
from wrenchpark.operators import ingest as I
from wrenchpark.operators import reports as R
from wrenchpark.operators.filters import JobFilter, iso_date_or_none, to_int_or_none
from wrenchpark.operators.listing import page_bounds


def test_search_keeps_wildcards_and_sets(spark):
    rows = [(1, "Reparación ÁREA norte", None), (2, "100% listo", "x"), (3, "a_b", "y"),
            (4, "caso b [ab]", "z"), (5, "ruta C:\\tmp", "w"), (6, None, "PROVEEDOR área")]
    df = spark.createDataFrame(rows, "id int, description string, provider string")

    def ids(text, cols=("description", "provider"), null_safe=False):
        p = search_predicate(text, list(cols), null_safe)
        return sorted(r.id for r in df.where(p).collect())

    assert ids("área") == [1, 6]            # case-insensitive, accents kept
    assert ids("0%l") == [2]                # % stays a wildcard
    assert ids("a_b") == [3, 4] or ids("a_b") == [3]
    assert ids("[ab] l") == []              # a set matches one character, not the text "[ab]"
    assert ids("s[aeiou] [a-b]") == [4]
    assert ids("C:\\tmp") == [5]            # backslash is literal
    assert ids("zz") == []


def test_like_to_regex():
    assert like_to_regex("a%b_c") == "a.*b.c"
    assert like_to_regex("[^ab]x") == "[^ab]x"
    assert like_to_regex("[a-c]") == "[a-c]"


def test_parameter_parsing():
    assert to_int_or_none("3") == 3 and to_int_or_none("3.0") == 3 and to_int_or_none(" 4 ") == 4
    assert to_int_or_none("1e1") == 10 and to_int_or_none("9007199254740993") == 9007199254740993
    assert to_int_or_none("1e999999999") is None and to_int_or_none(float("nan")) is None
    assert to_int_or_none("3.5") is None and to_int_or_none("") is None and to_int_or_none("abc") is None
    assert iso_date_or_none("2024-02-30") is None and iso_date_or_none("24-1-1") is None
    assert iso_date_or_none(" 2024-02-29 ") == "2024-02-29"
    assert page_bounds(None, None) == (0, 100)
    assert page_bounds("0", "1") == (0, 5)
    assert page_bounds("3", "999") == (400, 200)


def test_day_range_edges(spark):
    ts = ["1998-01-01 00:00:00", "1998-01-31 23:59:59", "1998-01-31 23:59:59.500", "1998-02-01 00:00:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id int, t string") \
        .select("id", F.col("t").cast("timestamp_ntz").alias("created_at"))
    got = sorted(r.id for r in JobFilter(date_from="1998-01-01", date_to="1998-01-31").apply(df).collect())
    assert got == [0, 1]                    # 23:59:59.5 is outside, next midnight too


def test_default_range_only_when_both_missing():
    f = JobFilter(date_from="2024-01-10").with_default_range("2024-03-01")
    assert f.dates() == ("2024-01-10", None)
    g = JobFilter(date_from="bad").with_default_range("2024-03-01")
    assert g.dates() == ("2024-01-31", "2024-03-01")


def test_validation_edges(spark):
    long = "x" * 4001
    rows = [
        ("1", "", "3", "2", "", "", None, None, None),
        ("2", "ok", "0", "2", "12,5", "a@b", "2024-02-30", None, None),
        ("3", "ok", "", "2", "1.234,5", "ana@x.cl", "24-1-1", None, None),
        ("4", "ok", "7.0", "2", "abc", "bad @x.cl", "2024-02-29", "", None),
        ("5", "  ok  ", "3", "2", "1e3", None, None, "0", None),
        ("6", long, "3", "x", " ", None, None, "2", "tec@example"),
    ]
    df = spark.createDataFrame(rows, "rid string, description string, location_id string, type_id string, "
                                     "net_value string, created_by_email string, repair_date string, "
                                     "priority_id string, owner_email string")
    v = {r.rid: r for r in I.validate(df).collect()}
    assert v["1"].errors == ["description"]
    assert v["2"].errors == ["location_id", "created_by_email", "repair_date"] and v["2"].net_value == Decimal("12.50")
    assert v["3"].errors == ["location_id", "net_value", "repair_date"]
    assert v["4"].errors == ["net_value", "created_by_email"] and v["4"].location_id == 7
    assert v["4"].priority_id is None and v["4"].repair_date == dt.date(2024, 2, 29)
    assert v["5"].errors == [] and v["5"].net_value == Decimal("1000.00") and v["5"].description == "ok"
    assert v["5"].priority_id is None
    assert v["6"].errors == ["type_id", "owner_email"] and len(v["6"].description) == 4000
    assert v["6"].net_value == Decimal("0.00") and v["6"].priority_id == 2
    upd = {r.rid: r for r in I.validate(df, mode="update").collect()}
    assert "status_id" in upd["5"].errors
    total = df.count()
    assert I.accepted(I.validate(df)).count() + I.rejected(I.validate(df)).count() == total


def test_csv_fields(spark):
    rows = [(1, 'say "hi"'), (2, "a;b"), (3, "line\nbreak"), (4, "cr\rhere"), (5, "  lead"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.f for r in df.select("id", X.csv_field(F.col("text")).alias("f")).collect()}
    assert got == {1: '"say ""hi"""', 2: '"a;b"', 3: '"line\nbreak"', 4: '"cr\rhere"', 5: "  lead", 6: "", 7: ""}


def test_csv_writer_roundtrip(spark, scratch):
    import glob
    import os

    from wrenchpark.sources.sinks import write_csv, write_csv_text
    rows = [(1, 'q"uote', None), (2, "semi;colon", "  blank ")]
    df = spark.createDataFrame(rows, "id int, description string, provider string")
    out = os.path.join(scratch, "csv")
    write_csv(df.coalesce(1), out)
    text = open(glob.glob(out + "/*.csv")[0], encoding="utf-8").read()
    assert text.splitlines()[0] == "id;description;provider"
    assert '1;"q""uote";' in text and '2;"semi;colon";  blank ' in text
    out2 = os.path.join(scratch, "csvtext")
    write_csv_text(df.coalesce(1), out2, columns=["id", "description", "provider"])
    files = sorted(glob.glob(out2 + "/part-*"))
    first = open(files[0], encoding="utf-8").read()
    assert first.startswith("\ufeffid;description;provider")


def test_top_providers_ties(spark):
    rows = [("  ACME ", Decimal("10.00")), ("ACME", Decimal("5.00")), ("Beta", Decimal("15.00")),
            (None, None), ("   ", None), ("Zeta", Decimal("15.00")), ("Alfa", Decimal("15.00"))]
    df = spark.createDataFrame(rows, "provider string, net_value decimal(12,2)")
    got = [(r.provider, r.total, r.amount) for r in R.top_providers(df, 3).collect()]
    assert got == [("ACME", 2, Decimal("15.00")), ("Alfa", 1, Decimal("15.00")), ("Beta", 1, Decimal("15.00"))]
    allnull = spark.createDataFrame([(None, None), ("", None)], "provider string, net_value decimal(12,2)")
    assert [(r.provider, r.total, r.amount) for r in R.top_providers(allnull).collect()] == [("—", 2, Decimal("0.00"))]


def test_top_providers_case_insensitive(spark):
    rows = [("ACME", Decimal("1.00")), ("acme ", Decimal("2.00")), ("Beta", Decimal("1.00"))]
    df = spark.createDataFrame(rows, "provider string, net_value decimal(12,2)")
    binary = sorted((r.provider, r.total) for r in R.top_providers(df).collect())
    assert binary == [("ACME", 1), ("Beta", 1), ("acme", 1)]
    ci = sorted((r.provider.lower(), r.total) for r in R.top_providers(df, collation="UNICODE_CI").collect())
    assert ci == [("acme", 2), ("beta", 1)]


def test_children_of(spark):
    from wrenchpark.operators.listing import children_of
    from wrenchpark.sources.testdata import DriverModel
    m = DriverModel(spark, "/root/testdata/sf0.001")
    ids = [r.id for r in children_of(m.comments, 3).collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) > 0
    assert len(ids) == m.read("conversations").where("conv_id = 3").count()


def test_uploads_with_unknown_group_or_type_are_refused(spark):
    from wrenchpark.operators.attachments import check_uploads
    rows = [(1, "antes", "image/png", 10), (2, "otros", "image/png", 10), (3, "antes", None, 10), (4, None, "image/png", 10)]
    df = spark.createDataFrame(rows, "upload_id int, group string, mime_type string, size_bytes long")
    got = {r.upload_id: (r.accepted, r.reason) for r in check_uploads(df).collect()}
    assert got == {1: (True, ""), 2: (False, "group"), 3: (False, "mime"), 4: (False, "group")}


def test_optional_table_reads_an_existing_path(spark, scratch):
    from wrenchpark import schema as S
    from wrenchpark.sources.tables import optional_table
    path = f"{scratch}/optional_catalog"
    assert optional_table(spark, path, S.CATALOG).count() == 0
    spark.createDataFrame([(1, "a")], S.CATALOG).write.parquet(path)
    assert optional_table(spark, path, S.CATALOG).count() == 1
    assert optional_table(spark, f"file://{path}", S.CATALOG).count() == 1


def test_updates_with_missing_references_never_win(spark):
    from wrenchpark.operators import changes as C
    from wrenchpark.operators.dims import Dim
    from wrenchpark import schema as S
    jobs = spark.createDataFrame([(1, 1, 1, 1, None), (2, 1, 1, 1, 1)], "id long, status_id int, type_id int, location_id int, priority_id int")
    cats = {c: Dim(spark.createDataFrame([(1, "x"), (2, "y")], S.CATALOG)) for c in ("status", "type", "location", "priority")}
    cols = ", ".join(f"{c} {'int' if c.endswith('_id') else 'string'}" for c in C.UPDATE_COLUMNS)
    at = {c: i for i, c in enumerate(C.UPDATE_COLUMNS)}

    def update(target, seq, **ids):
        row = [None] * len(at)
        for c, v in ({"status_id": 1, "type_id": 1, "location_id": 1} | ids).items():
            row[at[c]] = v
        return (target, seq, *row)

    ups = spark.createDataFrame([update(1, 1, type_id=2), update(1, 2, type_id=9, priority_id=7), update(5, 3, type_id=9)], f"target_id long, seq long, {cols}")
    snap, missing = C.apply_updates(jobs, ups, catalogs=cats)
    assert {r.id: r.type_id for r in snap.collect()} == {1: 2, 2: 1}
    assert [r.seq for r in missing.collect()] == [3]
    assert [(r.seq, r.reason) for r in C.update_rejects(jobs, ups, cats).collect()] == [(2, "fk:type,fk:priority")]


def test_exponent_ids_are_whole_numbers(spark):
    from wrenchpark.operators import ingest as I
    rows = [(1, "d", "1e1", "7.0", "2"), (2, "d", "1.5", "3", "1e-1")]
    v = I.validate(spark.createDataFrame(rows, "record_id long, description string, location_id string, type_id string, priority_id string"))
    got = {r.record_id: (r.location_id, r.type_id, r.priority_id) for r in v.collect()}
    assert got == {1: (10, 7, 2), 2: (None, 3, None)}


def test_manifest_to_registered_attachments(spark):
    from wrenchpark.operators import attachments as A
    big = 6 * 1024 * 1024
    rows = [("/in/7/despues/b.png", 10), ("/in/7/antes/a.JPG", 10), ("/in/7/antes/z.webp", 10),   # saved, in group order
            ("/in/8/antes/a.jpg", 10), ("/in/8/otro/b.jpg", 10),                                  # unknown group
            ("/in/9/antes/a.pdf", 10), ("/in/10/antes/a.jpg", big), ("/in/x/antes/a.jpg", 10)]    # type, size, no job
    files = spark.createDataFrame(rows, "path string, length long").withColumn("modificationTime", F.lit("2024-03-01 10:00:00").cast("timestamp"))
    checked = A.check_uploads(A.from_manifest(files), upload_col="job_id")
    reasons = {r.path: r.reason for r in checked.collect()}
    assert len(reasons) == len(rows)                            # no file is lost
    assert {reasons[p] for p, _ in rows[:3]} == {""} and {reasons[p] for p, _ in rows[3:5]} == {"group"}
    assert [reasons[p] for p, _ in rows[5:]] == ["mime", "size", "group"]
    existing = spark.createDataFrame([(41,)], "id long")
    saved = A.register_uploads(checked, existing).orderBy("id").collect()
    assert [(r.id, r.original_name, r.group) for r in saved] == [(42, "a.JPG", "antes"), (43, "z.webp", "antes"), (44, "b.png", "despues")]
    assert saved[0].file_path.startswith("/uploads/2024-03/7_20240301_100000_") and saved[0].file_path.endswith(".jpg")
    none = A.register_uploads(checked.limit(0), existing.limit(0))
    assert none.columns == saved[0].__fields__ and none.count() == 0
