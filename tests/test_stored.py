"""Stored tables: search by postings, pages by rank, uploads as files, merged
generations; bounded nests and the last change of a key."""

import datetime as dt
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wrenchpark.functions.search import search_predicate
from wrenchpark.operators import attachments as A
from wrenchpark.operators import changes as C
from wrenchpark.operators import listing as L
from wrenchpark.operators import rank_pages, search_index
from wrenchpark.operators import reports as R
from wrenchpark.operators.filters import to_int_or_none
from wrenchpark.sources.tables import merged_table

T0 = dt.datetime(2024, 1, 1)
TEXTS = ["Pump A-12 repaired", "pump a-13 REPAIRED 100%", "under_score [x] value", "Ñandú ÁRBOL árbol", "ab", "", None, "back\\slash path", "x" * 300, "aaa aab aba baa", "line\nbreak abc",
         "Straße İstanbul", "tab\tabc", "50% off", "[24] set"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def indexed(spark, scratch):
    rng = random.Random(4)
    rows = [(i * 37, rng.choice(TEXTS), rng.choice(TEXTS), "other") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    path = os.path.join(scratch, "idx")
    search_index.write_search_index(df, path, ["a", "b"])
    return df, path


@pytest.mark.parametrize("text", ["pump", "REPAIR", "a-1_", "a-1[23]", "p%a", "árbol", "Ñandú", "ab", "%", "_", "abc", "aab", "back\\slash", "xxxx", "nothing here", "[24]", "under[_]score",
                                  "[^x]ump", "50%", "score [[]x] val", "pair%100", "straße", "istanbul", "line_break", "aa_aba"])
def test_indexed_search_equals_plain(spark, indexed, text):
    df, path = indexed
    for columns in (["a", "b"], ["b"]):
        want = sorted(r.id for r in df.where(search_predicate(text, columns, True)).collect())
        assert sorted(r.id for r in search_index.search_stored(spark, path, text, columns).collect()) == want


def test_literal_runs_and_grams(spark):
    assert search_index.literal_runs("a%bcd_[x-z]ef[^q]g") == ["a", "bcd", "ef", "g"]
    assert search_index.literal_runs("open [ bracket") == ["open [ bracket"]
    got = spark.createDataFrame([("AbcAbc",), ("ab",), (None,)], "t string").select(search_index.grams_of(F.col("t")).alias("g")).collect()
    assert [sorted(r.g) for r in got] == [["abc", "bca", "cab"], [], []]


def test_search_reads_postings_and_refuses_null_ids(spark, indexed, scratch):
    _, path = indexed
    found = search_index.candidates(spark, path, "repaired", ["a", "b"])
    plan = _plan(found)
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan and "In(gram" in plan and "a#" not in plan.split("ReadSchema")[1]
    assert search_index.candidates(spark, path, "a_b%c", ["a"]) is None
    # The stored rows are filtered by the blocks of the candidates before their texts are read.
    assert "PartitionFilters: [" in _plan(search_index.search_stored(spark, path, "repaired", ["a", "b"]))
    with pytest.raises(ValueError, match="NULL"):
        search_index.write_search_index(spark.createDataFrame([(None, "x")], "id long, a string"), os.path.join(scratch, "idx_null"), ["a"])
    none = os.path.join(scratch, "idx_empty")
    search_index.write_search_index(spark.createDataFrame([], "id long, a string"), none, ["a"])
    assert search_index.search_stored(spark, none, "repaired", ["a"]).count() == 0


def test_search_over_many_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    df = spark.range(500).select("id", F.concat(F.lit("job number "), F.col("id").cast("string")).alias("a"))
    path = os.path.join(scratch, "idx_blocks")
    search_index.write_search_index(df, path, ["a"])
    got = sorted(r.id for r in search_index.search_stored(spark, path, "number 12", ["a"]).collect())
    assert got == [12, *range(120, 130)]
    # A gram that every row has is spread over the blocks.
    lists = spark.read.parquet(f"{path}/postings").where("gram = 'num'")
    assert lists.count() == 32 and lists.agg(F.max(F.size("ids"))).first()[0] == 16


def test_pages_by_rank_cover_the_list(spark, scratch):
    rows = [(i, T0 + dt.timedelta(hours=i % 50), f"t{i}") for i in range(730)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, name string")
    path = os.path.join(scratch, "ranked")
    rank_pages.write_ranked(df, path, rows_per_range=100)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    got = [r.id for page in range(1, 9) for r in rank_pages.page_by_rank(spark, path, page, 100).collect()]
    assert got == want
    assert rank_pages.page_by_rank(spark, path, 9, 100).count() == 0
    late = rank_pages.page_by_rank(spark, path, 30, 20)
    assert [r.id for r in late.collect()] == want[580:600]
    # Only the ranges of the page are read, and no task keeps the rows before it.
    plan = _plan(late)
    assert "PartitionFilters: [" in plan and "range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    ranges = spark.read.parquet(f"{path}/directory").collect()
    assert len(ranges) > 4 and sum(r.n for r in ranges) == 730
    empty = os.path.join(scratch, "ranked_empty")
    rank_pages.write_ranked(df.limit(0), empty)
    assert rank_pages.page_by_rank(spark, empty, 1, 20).count() == 0


def test_nest_of_a_job_with_a_million_attachments(spark):
    n = 1_000_000
    many = spark.range(n).select("id", F.lit(1).cast("long").alias("job_id"), F.concat(F.lit("/uploads/"), F.col("id").cast("string")).alias("file_path"),
                                 F.lit("antes").alias("group"), F.lit("f").alias("original_name"))
    few = spark.createDataFrame([(n + 1, 2, "/p", "antes", None), (n + 1, 2, "/q", "antes", "x"), (n + 2, 2, None, None, None)], "id long, job_id long, file_path string, group string, original_name string")
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    df = L.nested_attachments(jobs, many.union(few), most=50)
    got = {r.id: (r.attachments, r.more) for r in df.collect()}
    assert [a.id for a in got[1][0]] == list(range(n - 1, n - 51, -1)) and got[1][1] == n - 50
    assert [(a.id, a.file_path) for a in got[2][0]] == [(n + 2, None), (n + 1, "/q"), (n + 1, "/p")] and got[2][1] == 0
    assert got[3] == ([], 0)
    # Tasks cut their rows before each shuffle, in salted groups first.
    assert _plan(df).count("WindowGroupLimit") >= 4


def test_last_change_of_a_key(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *(T0 + dt.timedelta(seconds=s) for s in (-10**9, -1, 0, 1))]), rng.choice([None, -2**63, -1, 0, 5, 2**63 - 1]), f"v{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, seq long, v string, n int")
    low = lambda x: (x is not None, x if x is not None else 0)

    def best(order):
        top = {}
        for r in rows:
            top.setdefault(r[0], []).append(order(r))
        return {k: max(v) for k, v in top.items()}

    for order, key in ((["seq"], lambda r: (low(r[2]),)), (["ts", "seq"], lambda r: ((r[1] is not None, r[1] or T0), low(r[2])))):
        out = C.last_per_key(df, "k", order, ["ts", "seq", "v", "n"])
        got = out.collect()
        assert len(got) == 4
        want = best(key)
        for r in got:
            assert key((r.k, r.last.ts, r.last.seq)) == want[r.k]
        assert "SortAggregate" not in _plan(out) and "HashAggregate" in _plan(out)
    # Orders of other types still work.
    assert C.last_per_key(df, "k", ["v"], ["n"]).count() == 4
    same = spark.createDataFrame([(1, 7, "a")] * 3 + [(1, 7, "b")], "k int, seq long, v string")
    assert C.last_per_key(same, "k", ["seq"], ["v"]).count() == 1


def test_types_by_first_bytes(spark):
    heads = [(bytes.fromhex("FFD8FFE0") + b"x", "image/jpeg"), (bytes.fromhex("89504E470D0A1A0A"), "image/png"), (b"RIFF\x01\x02\x03\x04WEBPVP8", "image/webp"),
             (b"RIFF\x01\x02\x03\x04WAVEfmt", None), (b"%PDF-1.7", "application/pdf"), (b"GIF89a", None), (b"", None), (None, None)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(heads)], "i int, content binary")
    assert [r.m for r in df.select("i", A.sniffed_mime("content").alias("m")).orderBy("i").collect()] == [m for _, m in heads]


def test_scan_of_real_files(spark, scratch):
    root = os.path.join(scratch, "uploads")
    files = {"12/antes/photo.png": bytes.fromhex("FFD8FF") + b"jpeg inside", "12/despues/a b.jpg": b"plain text", "7/evidencia/big.webp": b"RIFF0000WEBP" + b"x" * 500, "stray.jpg": bytes.fromhex("FFD8FF")}
    for name, content in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(content)
    df = A.scan_uploads(spark, root, max_bytes=100)
    got = {r.original_name: (r.job_id, r.group, r.mime_type, r.size_bytes) for r in df.collect()}
    assert got == {"photo.png": (12, "antes", "image/jpeg", 14), "a b.jpg": (12, "despues", None, 10), "big.webp": (7, "evidencia", "image/webp", 512), None: (None, None, "image/jpeg", 3)}
    plan = _plan(df)
    assert "LessThanOrEqual(length,100)" in plan and plan.split("GreaterThan(length,100)")[1].split("ReadSchema")[1].split("\n")[0].count("content") == 0


def test_two_generations_in_one_read(spark, scratch):
    path = os.path.join(scratch, "generations")
    spark.createDataFrame([(1, "a")], "id int, tipo string").write.parquet(f"{path}/old")
    spark.createDataFrame([(2, "b", 5), (3, None, 6)], "id int, kind string, extra int").write.parquet(f"{path}/new")
    schema = spark.createDataFrame([], "id long, kind string, extra int, later date").schema
    df = merged_table(spark, [f"{path}/old", f"{path}/new"], schema, {"kind": ["tipo"]})
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a", None, None), (2, "b", 5, None), (3, None, 6, None)]
    assert _plan(df).count("FileScan") == 1


def test_collated_providers(spark):
    rows = [(" Émile", 1), ("ÉMILE", 2), ("émile ", 4), ("Ana", 8), ("", 16), (None, 32)]
    df = spark.createDataFrame(rows, "provider string, net_value int").withColumn("net_value", F.col("net_value").cast("decimal(12,2)"))
    ci = [(r.provider, r.total, int(r.amount)) for r in R.top_providers(df, collation="UNICODE_CI").collect()]
    assert ci == [("—", 2, 48), ("Ana", 1, 8), ("ÉMILE", 3, 7)]
    assert R.top_providers(df).count() == 5


@pytest.mark.parametrize("text, number", [("7", 7), ("7.0", 7), ("1.0000000001", None), ("1.00000000000000000001", 1), ("250e-1", 25), ("1e1", 10), (".5", None), ("1e400", None), ("0.99999999999999999999", 1), ("", None), ("+3", 3)])
def test_whole_numbers_as_the_source(spark, text, number):
    from wrenchpark.operators.ingest import validate
    row = validate(spark.createDataFrame([(text, "x")], "location_id string, description string")).first()
    assert row.location_id == number == to_int_or_none(text)


def test_ranges_share_folders(spark, scratch, monkeypatch):
    rows = [(i, T0 + dt.timedelta(hours=i % 50), f"t{i}") for i in range(730)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, name string")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    for most, folders in ((rank_pages.ROWS_PER_FOLDER, 1), (200, 4)):
        monkeypatch.setattr(rank_pages, "ROWS_PER_FOLDER", most)
        path = os.path.join(scratch, f"ranked_{most}")
        rank_pages.write_ranked(df, path, rows_per_range=10)
        directory = spark.read.parquet(f"{path}/directory").orderBy("first_rank").collect()
        # Folders, and so tasks, follow the rows and not the small ranges.
        assert len([f for f in os.listdir(f"{path}/rows") if f.startswith("ranges=")]) == len({r.ranges for r in directory}) <= folders
        assert len(directory) >= 73 and max(r.n for r in directory) == 10 and [r.first_rank for r in directory] == [sum(x.n for x in directory[:i]) for i in range(len(directory))]
        for page, size in ((1, 5), (7, 37), (20, 37), (3, 200)):
            assert [r.id for r in rank_pages.page_by_rank(spark, path, page, size).collect()] == want[(page - 1) * size:page * size]


def test_grams_of_arrow_texts(spark):
    texts = [*TEXTS, "a\U0001F600bc\U0001F600b", "ééé", "aaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.lower("t").alias("t"), search_index.grams_of(F.col("t")).alias("g")).orderBy("i").collect()
    want = {}
    for r in df:
        for g in r.g:
            want.setdefault(g, []).append(r.i)
    grams, places = search_index._lists(pa.array([r.t for r in df], pa.string()), np.array([r.i for r in df]))
    assert dict(zip(grams, places.to_pylist(), strict=True)) == want and len(grams) == len(want)
    # Bytes that are no UTF-8 keep the grams around them.
    grams, places = search_index._lists(pa.array([b"abc\xffdef", b"", None], pa.binary()), np.array([5, 6, 7]))
    assert {"abc", "def"} <= set(grams) and places.to_pylist()[grams.index("def")] == [5]
    assert search_index._lists(pa.array([None, "ab"], pa.string()), np.array([0, 1]))[0] == []


def test_a_block_may_have_several_arrays(monkeypatch):
    monkeypatch.setattr(search_index, "CHUNK_ROWS", 3)
    batches = [pa.RecordBatch.from_pydict({"block": [0, 0, 1, 1], "place": pa.array([9, 8, 7, 6], pa.int32()), "text0": ["abc", "abc", "abcd", None]}),
               pa.RecordBatch.from_pydict({"block": [1, 1], "place": pa.array([5, 5], pa.int32()), "text0": ["abc", "abc"]})]
    got = [(r["gram"], r["block"], r["ids"]) for b in search_index._post(["t"])(iter(batches)) for r in b.to_pylist()]
    assert got == [("abc", 0, [8, 9]), ("abc", 1, [7]), ("bcd", 1, [7]), ("abc", 1, [5, 5])]


def test_search_of_negative_and_repeated_ids(spark, scratch):
    rows = [(-(1 << 16), "alpha beta"), (-1, "beta alpha"), (-1, "alphabet"), (2**62 + 1, "xalphax"), (2**62 + 2, "beta"), (3, None)]
    path = os.path.join(scratch, "idx_odd_ids")
    search_index.write_search_index(spark.createDataFrame(rows, "id long, a string"), path, ["a"])
    assert sorted(tuple(r) for r in search_index.search_stored(spark, path, "alpha", ["a"]).collect()) == sorted(r for r in rows if r[1] and "alpha" in r[1])


def test_postings_are_made_from_stored_blocks(spark, scratch):
    path = os.path.join(scratch, "idx_stored")
    search_index.write_search_index(spark.range(100).select("id", F.concat(F.lit("job "), "id").alias("a")), path, ["a"])
    assert dict(spark.read.parquet(f"{path}/postings").dtypes)["ids"] == "array<int>"


def test_nest_shuffles_ordinary_jobs_once(spark, monkeypatch):
    monkeypatch.setattr(L, "NEST_FEW", 5)
    monkeypatch.setattr(L, "NEST_SALTS", 2)
    rng = random.Random(6)
    rows = [(rng.randrange(40), job, rng.choice([None, "/p", "/q"]), "antes", None) for job, n in ((1, 300), (2, 7), (3, 5), (None, 50), (4, 1)) for _ in range(n)]
    files = spark.createDataFrame(rows, "id long, job_id long, file_path string, group string, original_name string")
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "id long")
    df = L.nested_attachments(jobs, files, most=3)
    assert "LeftAnti, BuildRight" in _plan(df) and "LeftSemi, BuildRight" in _plan(df)
    got = {r.id: ([(a.id, a.file_path) for a in r.attachments], r.more) for r in df.collect()}
    for job in (1, 2, 3, 4, 5):
        mine = sorted(((r[0], r[2]) for r in rows if r[1] == job), key=lambda x: (x[0], x[1] is not None, x[1] or ""), reverse=True)
        assert got[job] == (mine[:3], max(len(mine) - 3, 0))
    assert got[None] == ([], 0)


def _places(df):
    """The places and attachments of each job's rows, in the order of the places."""
    got = {}
    for r in df.collect():
        for i, a in enumerate(r.attachments):
            got.setdefault(r.id, []).append((r.first + i, (a.id, a.file_path, a.group, a.original_name)))
    return {job: sorted(rows, key=lambda x: x[0]) for job, rows in got.items()}


def _newest_first(rows):
    return sorted(rows, key=lambda r: [(v is not None, 0 if v is None else v) for v in r], reverse=True)


def test_nest_holds_all_attachments_of_a_job(spark):
    n = 100_000
    many = spark.range(n).select("id", F.when(F.col("id") < 1500, 1).otherwise(2).cast("long").alias("job_id"), F.concat(F.lit("/p"), "id").alias("file_path"),
                                 F.lit("antes").alias("group"), F.lit(None).cast("string").alias("original_name"))
    df = L.nested_attachments(spark.createDataFrame([(1,), (2,), (3,)], "id long"), many)
    rows = df.collect()
    assert [(r.first, len(r.attachments), r.more) for r in rows if r.id == 1] == [(0, 1500, 0)]
    assert [(r.first, r.attachments, r.more) for r in rows if r.id == 3] == [(0, [], 0)]
    # A large job's list is cut into pieces, each of which knows its place.
    assert len([r for r in rows if r.id == 2]) > 1 and {r.more for r in rows} == {0}
    got = _places(df)
    assert [(i, a[0]) for i, a in got[1]] == list(enumerate(range(1499, -1, -1)))
    assert [(i, a[0]) for i, a in got[2]] == list(enumerate(range(n - 1, 1499, -1)))


def test_nest_pieces_of_nulls_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "NEST_FEW", 5)
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(30)]), job, rng.choice([None, "", "/p", "/q"]), rng.choice([None, "antes"]), rng.choice([None, "x"]))
            for job, n in ((1, 500), (2, 60), (3, 6), (4, 5), (5, 1), (None, 300), (9, 200)) for _ in range(n)]
    rows += [(7, 6, "/same", "antes", None)] * 40
    files = spark.createDataFrame(rows, "id long, job_id long, file_path string, group string, original_name string")
    # Ids of jobs may be NULL, or come twice: each of their rows has the whole list.
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,), (7,), (None,), (2,)], "id long")
    df = L.nested_attachments(jobs, files)
    got = _places(df)
    for job in (1, 2, 3, 4, 5, 6):
        want = _newest_first([(r[0], *r[2:]) for r in rows if r[1] == job])
        assert got[job] == [(i, a) for i, a in enumerate(want) for _ in range(2 if job == 2 else 1)]
    rows_of = [r.id for r in df.collect()]
    assert set(rows_of) == {1, 2, 3, 4, 5, 6, 7, None} and rows_of.count(1) > 20 and [rows_of.count(x) for x in (4, 5, 7, None)] == [1] * 4
    assert {r.id: r.attachments for r in df.where("id = 7 or id is null").collect()} == {7: [], None: []}
    # No list is broadcast: the join is by job and piece, as the nests were shuffled.
    assert re.search(r"SortMergeJoin \[id#\d+L, __at#\d+\], \[job_id#\d+L, __piece#\d+\]", _plan(df))


@pytest.mark.parametrize("few", [10_000, 200])
def test_nested_query_and_detail_of_a_job_with_many_attachments(spark, scratch, monkeypatch, few):
    from wrenchpark.plans import registry
    monkeypatch.setattr(L, "NEST_FEW", few)
    sf = os.path.join(scratch, f"many_files_{few}")
    base = "/root/testdata/sf0.001"
    os.makedirs(sf)
    for name in ("orders", "customer", "nation"):
        os.symlink(f"{base}/{name}.parquet", f"{sf}/{name}.parquet")
    first = spark.read.parquet(f"{base}/lineitem.parquet").limit(1).drop("l_orderkey", "l_partkey", "l_suppkey")
    first.crossJoin(spark.range(2500)).select("*", F.lit(7).cast("long").alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey")).drop("id").write.parquet(
        f"{sf}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{sf}/lineitem.parquet/*.parquet')")
    for key, columns in (("job_attachments_nested", ["id", "pos", "attachment_id", "group", "file_path"]), ("job_detail", ["id", "n_attachments", "newest_attachment_id", "attachment_ids"])):
        want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.oracle_sql()[key]})").fetchall()
        got = registry.queries()[key](spark, sf).select(*[f"`{c}`" for c in columns]).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) == (2500 if key == "job_attachments_nested" else 1)


def test_upload_files_are_dealt_over_tasks(spark, scratch, monkeypatch):
    from wrenchpark.plans import q_stored
    from wrenchpark.sources.testdata import DriverModel
    spark.createDataFrame([(i, f"Supplier#{i}") for i in range(200)], "s_suppkey long, s_name string").write.parquet(os.path.join(scratch, "up", "supplier.parquet"))
    path = os.path.join(scratch, "up_files")
    monkeypatch.setattr(q_stored, "_fresh", lambda m, name: path)
    assert q_stored.uploads_scanned(DriverModel(spark, os.path.join(scratch, "up"))).count() == 200
    names = [f for _, _, files in os.walk(path) for f in files if f.startswith("part-")]
    # One file for each supplier; the job's small bytes do not put all of them into one task.
    assert len(names) == 200 and len({f.split("-")[1] for f in names}) >= 6
