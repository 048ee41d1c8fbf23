import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wrenchpark.llm import boosting, quality, textnum

SF = "/root/testdata/sf0.01"


def test_trees_learn_a_rule_and_flat_walk_equals_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    m = boosting.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97

    def plain(row):
        out = m.base
        for f, t, v in zip(m.feature, m.threshold, m.value):
            i = 0
            for _ in range(m.depth):
                i = 2 * i + (2 if f[i] >= 0 and row[f[i]] > t[i] else 1)
            out += v[i - (2 ** m.depth - 1)]
        return out

    assert np.allclose([plain(r) for r in x[:50]], m.margin(x[:50]))


def test_degenerate_training():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (boosting.fit(np.ones((5, 3)), np.ones(5)).score(np.ones((1, 3))) > 0.99).all()


def test_words_equal_a_plain_split():
    texts = ["", " a b\tc", "x", "é ü", "end ", "\n", "a  b"]
    data, off = textnum.utf8(pa.array(texts))
    s, e, d = textnum.words(data, off)
    got = [[] for _ in texts]
    for a, b, i in zip(s, e, d):
        got[i].append(bytes(data[a:b]).decode())
    assert got == [t.split() for t in texts]


def test_statistics_do_not_depend_on_the_batch():
    texts = ["The cat sat.\nThe cat sat.", None, "", "AAA!! BBB!!", "x" * 50_000, "é | ü | ö"]
    whole = quality.statistics(pa.array(texts))
    assert whole.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], whole[i])


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.op10_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 0)], [(1, 0, 0), (1, 1, 0), (2, 1, 0), (None, 1, 1)]])
def test_edges(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, "q " * 30000)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("stats", "score", "held_out", "quality")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    if not labels:
        assert {r.score for r in got} == {0.5}
    assert quality.classify(docs.limit(0), lab).count() == 0


def test_texts_are_measured_in_small_slices(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 10_000)) for _ in range(60)] + ["", None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(62)), "text": texts})
    sizes, whole = [], quality.statistics(batch.column(1)).astype(np.float32)
    once = quality.statistics
    monkeypatch.setattr(quality, "statistics", lambda col: (sizes.append(len(textnum.utf8(col)[0])), once(col))[1])
    got = pa.Table.from_batches(quality._measure(iter([batch])))
    assert max(sizes) <= 1 << 19 and sum(sizes) == sum(len(t or "") for t in texts)
    assert got.column("doc_id").to_pylist() == list(range(62))
    stats = got.column("stats").combine_chunks().flatten().to_numpy().reshape(62, -1)
    assert np.allclose(stats, whole, rtol=1e-6)
