import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wrenchpark.llm import packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    encode = packing.Encoder(open(PATH, encoding="utf-8").read())
    texts = ["", " ", "a\n\n b", "<|endoftext|>x", "é" * 700, "x" * 3000, "日本 ٣ ʰ", "it's I'LL", "tab\t\t end  ", "a  b\u0085c"]
    texts += [f"a {chr(c)}b{chr(c)}{chr(c)} 1" for c in range(0x600)]
    texts += ["".join(rng.choice("ab é\n\t'1!<|") for _ in range(300)) for _ in range(100)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encode(t).tolist() == e.ids, repr(t[:40])


def test_related_tails_share_sequences():
    rng = np.random.default_rng(0)
    topics = [np.arange(1 + 100 * k, 101 + 100 * k) for k in range(4)]
    tails = [rng.choice(topics[i % 4], 256).astype(np.uint32) for i in range(80)]
    sequences = list(packing.pack_tails(tails, np.ones(500), 256.0))
    assert all(sum(p[2] for p in s) == 1024 for s in sequences) and len(sequences) == 20
    alike = [len({p[0] % 4 for p in s}) == 1 for s in sequences]
    assert sum(alike) >= 18


def check(rows, docs, library, shards):
    want = {}
    for k, (i, t) in enumerate(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault((i, len(ids)), []).append(np.array(ids, "<u4"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        assert sorted(r.start for r in pieces)[0] == 0
        for copies in [want[key]]:
            ends = sorted((r.start, r.length) for r in pieces)
            assert sum(n for _, n in ends) == key[1] * len(copies)
            if len(copies) == 1:
                assert [s for s, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1].tolist()]
            for r in pieces:
                assert r.ids_crc32 in {zlib.crc32(c[r.start:r.start + r.length].tobytes()) for c in copies}
    pad = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        n = sum(r.length for r in pieces)
        assert 0 < n <= 1024 and all(r.length > 0 for r in pieces)
        pad += 0 if n & (n - 1) == 0 else 1024 - n
    assert pad <= 1024 * shards


@pytest.mark.parametrize("per_shard", [1500, 40])
def test_op2_on_the_table(spark, library, monkeypatch, per_shard):
    monkeypatch.setattr(packing, "ROWS_PER_SHARD", per_shard)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = packing.op2_bm25_packing(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7
    check(got.collect(), docs, library, -(-len(docs) // per_shard))


def test_odd_rows(spark, library):
    docs = [(None, None), (1, ""), (1, ""), (2, "word " * 5000), (None, "a b c"), (3, "x" * 5000), (4, "<|endoftext|>")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "shard", "total", "tail", "start")})
    check(packing.pack(df).collect(), docs, library, 1)
    assert packing.pack(df.limit(0)).count() == 0
    one = packing.pack(df.where("doc_id = 1").limit(1)).collect()
    assert [(r.start, r.length, r.offset, r.doc_tokens) for r in one] == [(0, 1, 0, 1)]
