import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchpark.llm import shards as S


def feasible(sizes, cap, n):
    used, room = 1, cap
    for s in sizes:
        if s > cap:
            return False
        if s > room:
            used, room = used + 1, cap
        room -= s
    return used <= n


@pytest.mark.parametrize("seed", range(5))
def test_least_capacity_is_minimal(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 50, 200)
    cap, ends = S.least_capacity(sizes, 7)
    assert feasible(sizes, cap, 7) and not feasible(sizes, cap - 1, 7)
    bounds = [0, *ends]
    assert bounds[-1] == len(sizes)
    assert all(sizes[a:b].sum() <= cap for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("seed,n", [(0, 400), (1, 3000)])
def test_cuts_found_from_ranges_equal_cuts_over_all_groups(spark, monkeypatch, seed, n):
    # Two bits at the top and two a step: many rounds of splitting.
    monkeypatch.setattr(S, "TOP_BITS", 4)
    monkeypatch.setattr(S, "STEP_BITS", 4)
    rng = random.Random(seed)
    rows = [(k, rng.randint(1, 500)) for k in sorted({rng.getrandbits(60) for _ in range(n)})]
    cuts = S.minimax_cuts(spark.createDataFrame(rows, "key long, w long"), 9)
    _, ends = S.least_capacity(np.array([w for _, w in rows]), 9)
    keys = [k for k, _ in rows]
    assert [bisect.bisect_left(keys, c) for c in cuts] == [e for e in ends if e < len(rows)]


def check(rows, docs, n_shards):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert 0 <= r.shard < n_shards
    for got in by.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    return by


def test_shards_are_near_equal_and_keep_equal_texts_together(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS_PER_CELL", 5)
    rng = random.Random(3)
    docs = [(i, "x" * rng.randint(0, 200) + str(i // 2)) for i in range(2000)]
    rows = S.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), 10).collect()
    by = check(rows, docs, 10)
    sums = [sum(r.size for r in v) for v in by.values()]
    assert len(sums) == 10 and max(sums) <= 1.02 * sum(sums) / 10 and min(sums) >= 0.9 * sum(sums) / 10
    place = {}
    text = dict(docs)
    for r in rows:
        assert place.setdefault(text[r.doc_id], r.shard) == r.shard


def test_hot_group_gets_its_own_shard(spark):
    docs = [(i, "hot") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(800)]
    rows = S.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()
    by = check(rows, docs, 5)
    sums = sorted(sum(r.size for r in v) for v in by.values())
    assert len(sums) == 5 and sums[3] - sums[0] <= 100


def test_nulls_repeats_empty_and_clashing_columns(spark):
    docs = [(None, None), (1, ""), (1, ""), (2, "é" * 30000), (3, None), (None, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df = df.withColumns({c: F.lit(7) for c in ("size", "key", "shard", "slot", "row", "w", "cell")})
    check(S.shard_by_bytes(df, 4).collect(), docs, 4)
    assert S.shard_by_bytes(df.limit(0), 4).count() == 0
    assert {r.shard for r in S.shard_by_bytes(df, 1).collect()} == {0}
