import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wrenchpark.llm import repeats, suffixes, textnum

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_equals_sorting(seed):
    rng = random.Random(seed)
    s = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randint(0, 80))]
    if seed % 3 == 0:
        s = s[:15] * 6
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", range(8))
def test_repeated_windows_equal_counting(seed):
    rng = random.Random(seed)
    parts = [bytes(rng.choice(b"ab ") for _ in range(rng.randint(1, 30))) for _ in range(12)] + [b"a" * 40, "é".encode() * 9]
    blocks = [b"".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(30)]
    width = rng.choice([5, 12, 30])
    every = [b[i:i + width] for b in blocks for i in range(len(b) - width + 1)]
    count = {w: every.count(w) for w in set(every)}
    got = suffixes.repeated_windows(blocks, width)
    assert [f.tolist() for f in got] == [[count[b[i:i + width]] > 1 for i in range(len(b) - width + 1)] for b in blocks]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 101, 500):
        assert repeats.sliding_minimum(x, w).tolist() == [int(x[i:i + w].min()) for i in range(len(x) - w + 1)]


def test_blocks_cover_every_window_once():
    rng = random.Random(3)
    texts = ["", "x" * 199, "x" * 200, "x" * 900] + ["".join(rng.choice("abcde ") for _ in range(rng.randint(150, 1500))) for _ in range(20)]
    data, off = textnum.utf8(pa.array(texts))
    doc, start, n, anchor, content = repeats.blocks_of(data, off)
    seen = sorted((d, s + i) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist()) for i in range(k))
    assert seen == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 199)]
    assert (n <= 101).all()


def expected(docs):
    count = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        for k in range(len(b) - 199):
            w = hashlib.md5(b[k:k + 200]).digest()
            count[w] = count.get(w, 0) + 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if count[hashlib.md5(b[k:k + 200]).digest()] > 1:
                gone[k:k + 200] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string") if isinstance(docs, list) else docs
    monkeypatch.setattr(repeats, "table", lambda *_: df)
    return sorted(map(tuple, repeats.op1_lyndon_suffixes(spark, "").collect()), key=str)


@pytest.mark.parametrize("most", [2000, 2])
def test_removal_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_KINDS", most)
    rng = random.Random(most)
    text = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    passages = [text(rng.randint(150, 600)) for _ in range(6)] + ["ab" * 200, "z" * 500]
    docs = []
    for i in range(70):
        t = text(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randint(0, 60):] + text(rng.randint(0, 80))
        docs.append((i, t))
    docs += [(100 + i, docs[5][1]) for i in range(5)]
    assert result(spark, docs, monkeypatch) == expected(docs)


def test_odd_rows(spark, monkeypatch):
    docs = [(None, None), (None, ""), (1, "q" * 250), (2, "short"), (3, "k" + "abc" * 80), (3, "k" + "abc" * 80), (None, "n" + "xyz" * 90 + "!"), (5, "y" * 200), (6, "é" * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("th", "start", "n", "a", "c", "spans", "bytes")})
    assert result(spark, df, monkeypatch) == expected(docs)
    assert result(spark, df.limit(0), monkeypatch) == []
    kept = {r.text for r in repeats.remove_repeats(df).collect() if r.doc_id is None}
    assert None in kept and "" in kept and repeats.remove_repeats(df).columns == df.columns


def test_op1_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = repeats.op1_lyndon_suffixes(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs)


def test_blocks_are_cut_in_small_slices(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(10_000)) for _ in range(60)] + [""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(61)), "th": [0] * 61, "text": texts})
    sizes, once = [], repeats.blocks_of
    doc, start, n, _, content = once(*textnum.utf8(batch.column(2)))
    monkeypatch.setattr(repeats, "blocks_of", lambda data, off: (sizes.append(len(data)), once(data, off))[1])
    got = pa.Table.from_batches(repeats._blocks(iter([batch])))
    assert max(sizes) <= 1 << 19 and sum(sizes) == sum(map(len, texts))
    for name, want in (("doc_id", doc), ("start", start), ("n", n), ("c", content)):
        assert np.array_equal(got.column(name).to_numpy(), want)
