import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_vectors import reachable

from wrenchpark.llm import near, textnum
from wrenchpark.llm.common import stage
from wrenchpark.llm.groups import complete_groups

SF = "/root/testdata/sf0.01"


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(docs, k):
    sets = {i: shingle_set(t, k) for i, t in docs}
    owners, links = {}, []
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in owners[x]:
                if j > i:
                    both[j] = both.get(j, 0) + 1
        links += [(i, j) for j, n in both.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
    root = reachable(sets, links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets.items())


def near_copies(rng, n, words=60, swaps=2):
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, swaps)):
            w[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def test_shingles_equal_plain_sets():
    texts = ["", " ", "One two", "A b\tc D e", "a b c d e a b c d e", "é É x y z w q", "x " * 50]
    data, off = textnum.utf8(pa.array(texts))
    doc, h = textnum.shingles(data, off, 4)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [len(shingle_set(t, 4)) for t in texts]
    a, b = textnum.shingles(*textnum.utf8(pa.array(["zz", "a B c d"])), 4)
    c, d = textnum.shingles(*textnum.utf8(pa.array(["A b  C D"])), 4)
    assert b[a == 1].tolist() == d.tolist()


def test_trees_find_pairs_at_every_depth(spark):
    assert [near.miss_rate(0.8, d) < 1e-5 for d in (1, 2, 3)] == [True] * 3
    # The branching itself: pairs that agree in 21 of 32 tokens, which the rate also counts, with every node taken for a large one.
    rng, pairs = np.random.default_rng(3), 300
    rows = []
    for i in range(pairs):
        a = rng.integers(-2**31, 2**31 - 1, near.COORDS)
        b = a.copy()
        b[rng.permutation(near.COORDS)[:11]] += 1
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
    sigs = spark.createDataFrame(rows, "cid long, sig array<int>")
    nodes = sigs.select(F.explode(F.array(*[F.xxhash64(F.lit(t)) for t in range(1, near.TREES + 1)])).alias("node"), "cid", F.col("cid").alias("label"), "sig")
    for depth in (1, 2, 3):
        kids = near._branch(nodes, depth).distinct()
        both = kids.groupBy("node", F.floor(F.col("cid") / 2).alias("pair")).agg(F.count("*").alias("n")).where("n = 2")
        # A pair that parts in a node never meets below it.
        met = both.select("node", F.explode(F.array(F.col("pair") * 2, F.col("pair") * 2 + 1)).alias("cid"))
        nodes = stage(met.join(sigs, "cid").select("node", "cid", F.col("cid").alias("label"), "sig"), "test-nodes")
        assert nodes.select(F.floor(F.col("cid") / 2)).distinct().count() >= pairs - 2


def test_complete_groups():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5]
    whole = pa.record_batch({"k": keys, "i": list(range(10))})
    for step in (1, 2, 3, 4, 10):
        seen = [t.column("k").to_pylist() for t in complete_groups((whole.slice(i, step) for i in range(0, 10, step)), "k")]
        assert sum(seen, []) == keys
        assert sorted(k for s in seen for k in set(s)) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:
        # Many large nodes: leaders, several levels, and blocks at the end.
        monkeypatch.setattr(near, "LEAF", 4)
        monkeypatch.setattr(near, "LEAF_PAIRS", 16)
        monkeypatch.setattr(near, "STEPS", near.STEPS[:2])
        monkeypatch.setattr(near, "BLOCK", 10)
    rng = random.Random(1)
    texts = near_copies(rng, 60) + near_copies(rng, 40, swaps=6) + ["copy of the same words here"] * 30
    for n in (1, 2, 2, 3, 5):
        texts += near_copies(rng, n, words=rng.randint(3, 300))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{rng.random()}" for _ in range(rng.randint(2, 60))) for _ in range(50)]
    docs = list(enumerate(texts))
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4)
    assert sorted(map(tuple, got.collect())) == expected(docs, 4)


def test_op6_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = near.op6_chosen_path(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect())) == expected(docs, 4)


def test_odd_rows(spark):
    docs = [(5, None), (6, ""), (7, " \n"), (8, "One Two"), (9, "one two"), (9, "one two"), (None, "one two"), (None, None), (10, "one"),
            (11, "x y z " * 20000), (12, "X y z " * 20001)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "k1", "k2", "sig", "cid", "node", "label")})
    got = sorted(map(tuple, near.near_duplicates(df, words=4).collect()), key=str)
    assert got == sorted([(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False),
                          (None, 1, None, True), (None, 0, None, True), (10, 1, 10, True), (11, 3, 11, True), (12, 3, 11, False)], key=str)
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_does_not_multiply(spark, monkeypatch):
    """600 near copies of one text, ten times over a leaf: labels and the members outside them keep the nodes few."""
    monkeypatch.setattr(near, "LEAF", 60)
    monkeypatch.setattr(near, "LEAF_PAIRS", 3600)
    docs = list(enumerate(near_copies(random.Random(11), 600, words=60, swaps=1)))
    staged, plain = {}, near.stage

    def counted(df, name):
        out = plain(df, name)
        staged[name] = staged.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near, "stage", counted)
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4)
    assert sorted(map(tuple, got.collect())) == expected(docs, 4)
    assert staged["near-nodes"] < 40 * len(docs) and staged["near-close"] < 20 * len(docs)


def test_recall_with_small_leaves(spark, monkeypatch):
    """Nearly all links of the table are found when most nodes are large."""
    monkeypatch.setattr(near, "LEAF", 8)
    monkeypatch.setattr(near, "LEAF_PAIRS", 64)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: r[2] for r in expected(docs, 4)}
    got = {r.doc_id: r.component_id for r in near.op6_chosen_path(spark, SF).collect()}
    linked = [d for d in want if want[d] != d]
    assert sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked)


def test_sets_are_hashed_in_small_slices():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(10_000)) for _ in range(60)] + ["", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(62)), "text": texts})
    got = list(near._sets(iter([batch]), 5))
    size = [sum(len(t or "") for t in b.column(1).to_pylist()) for b, _, _, _ in got]
    assert max(size) <= 1 << 20 and sum(b.num_rows for b, _, _, _ in got) == 62
    whole = textnum.shingles(*textnum.utf8(batch.column(1)), 5)[1]
    assert np.array_equal(np.concatenate([h for _, _, _, h in got]), whole)
