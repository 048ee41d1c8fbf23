import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchpark.llm import knn, rangejoin
from wrenchpark.llm.components import components

SF = "/root/testdata/sf0.01"


def reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(60)] + [(100, 101), (101, 100)],
    [(i, (i * 7 + 3) % 97) for i in range(60)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == reachable({n for e in real for n in e}, real)


def knn_expected(rows, is_query, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = []
    for i, q in rows:
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [1, 6])
def test_knn_equals_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 40)
    monkeypatch.setattr(knn, "QUERIES_PER_BLOCK", 5)
    monkeypatch.setattr(knn, "DATA_PER_BLOCK", 60)
    monkeypatch.setattr(knn, "CHUNK", 32)
    rng = np.random.default_rng(clusters)
    centre = rng.normal(size=(clusters, 4)) * 40
    rows = [(i, [int(c) for c in centre[i % clusters] + rng.normal(size=4) * 3]) for i in range(500)]
    rows += [(1000 + i, [5, 5, 5, 5]) for i in range(120)]
    got = knn.knn_join(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 10 == 0, 5)
    assert sorted(map(tuple, got.collect())) == knn_expected(rows, lambda i: i % 10 == 0, 5)


def test_far_cells_are_not_replicated():
    pivots = np.array([[100.0, 0], [-100.0, 0]])
    summary = [type("S", (), {"cell": c, "edge": 1.0, "n": 50}) for c in (0, 1)]
    sure = knn.assured(pivots, tuple(np.array(x) for x in zip(*((s.cell, s.edge, s.n) for s in summary), strict=True)), pivots[0], 1.0, 5)
    assert pivots[1] @ pivots[0] + 100 * 1 + 1 * 101 < sure


def test_op8_on_the_table(spark):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = knn.op8_voronoi_knn(spark, SF)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == knn_expected(rows, lambda i: i % 50 == 0, 5)


ODD = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (50, [1.0, 0.0]),
       (50, [1.0, 0.0]), (6, [2.0]), (7, [0.0, 1.0]), (None, [1.0, 0.0]), (8, [1e300, 1e290]), (9, [1e-300, 0.0])]


def test_knn_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").where("vec_id is null or vec_id not in (8)")
    df = df.withColumns({c: F.lit(1) for c in ("v", "cell", "g", "salt", "score")})
    rows = [(1, [0, 0]), (2, [0, 0]), (50, [256, 0]), (6, [512, 0]), (7, [0, 256]), (9, [0, 0])]
    got = knn.knn_join(knn.quantised(df), F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == knn_expected(rows, lambda i: i % 50 == 0, 5)
    assert knn.knn_join(knn.quantised(df.limit(0)), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_knn_of_a_repeated_query_id(spark, monkeypatch):
    """Rows with the query's id are no candidates, however many there are, and the bounds know it."""
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 4)
    rng = np.random.default_rng(2)
    rows = [(50, rng.integers(-9, 9, 3).tolist()) for _ in range(8)] + [(i, rng.integers(-9, 9, 3).tolist()) for i in range(1, 7)]
    got = knn.knn_join(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 50 == 0, 5)
    best = sorted((-int(np.dot(q, v)), j) for i, q in rows if i == 50 for j, v in rows if j != 50)[:5]
    assert sorted(map(tuple, got.collect())) == [(50, r + 1, j, -s) for r, (s, j) in enumerate(best)]


def range_expected(rows, cosine):
    v = np.array([x for _, x in rows], float)
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = u @ u.T >= cosine
    ids = [i for i, _ in rows]
    root = reachable(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a != b])
    return sorted((i, int(near[k].sum()) - 1, root[i], root[i] == i) for k, i in enumerate(ids))


@pytest.mark.parametrize("seed", [0, 1])
def test_range_join_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(rangejoin, "ROWS_PER_PIVOT", 40)
    monkeypatch.setattr(rangejoin, "INNER_BLOCK", 30)
    monkeypatch.setattr(rangejoin, "OTHER_BLOCK", 50)
    monkeypatch.setattr(rangejoin, "TILE", 16)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, 5))
    rows = [(i, (centre[rng.integers(25)] + rng.normal(size=5) * rng.choice([0.05, 0.3, 1])).tolist()) for i in range(450)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60)] + [(2000 + i, [(i + 1) * c for c in (1.0, 2.0, 3.0, 4.0, 5.0)]) for i in range(20)]
    got = rangejoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == range_expected(rows, 0.95)


def test_op7_on_the_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rangejoin.op7_metric_range_join(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect())) == range_expected(rows, 0.95)


def test_range_join_odd_rows(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit(1) for c in ("v", "id", "key", "cell", "n", "node", "component")})
    got = {}
    for r in rangejoin.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    linked = {50: 6, 6: 6, 8: 6, 9: 6}
    for i, rows in got.items():
        for n, c, kept in rows:
            if i in linked:
                assert n == 4 and c == 6 and kept == (i == 6)
            else:
                assert (n, c, kept) == (0, i, True)
    assert sum(map(len, got.values())) == len(ODD)
    assert rangejoin.near_duplicates(df.limit(0)).count() == 0
