import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wrenchpark.llm import bpe
from wrenchpark.llm.automaton import IntTable, Lexicon, compile_words

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


def test_int_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    t = IntTable(keys, np.arange(len(keys)))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert (t.get(np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)) == -1).all()


def test_automaton_is_minimal_and_ranks_words():
    words = sorted({"".join(random.Random(i).choices("ab", k=i % 7 + 1)).encode() + b"ing" for i in range(60)} | {b"a", b"b", b"zz"})
    flat = Lexicon.build({w: [i, i + 1] for i, w in enumerate(words)})
    lex = Lexicon(flat)
    for w in words + [b"", b"ing", b"aing!", b"q"]:
        rank = lex.ranks(np.frombuffer(w, np.uint8)[None, :])[0]
        assert rank == (words.index(w) if w in words else -1)
        if rank >= 0:
            assert lex.ids[lex.starts[rank]:lex.starts[rank + 1]].tolist() == [rank, rank + 1]
    keys, targets, _, accepting = compile_words(words)
    # No two states have the same accepting flag and edges.
    edges = {s: (bool(accepting[s]), tuple((int(k) % 256, int(t)) for k, t in zip(keys, targets) if k // 256 == s)) for s in {0, *targets.tolist()}}
    assert len(set(edges.values())) == len(edges)


def check(encoder, split, library, texts):
    got = list(encoder.texts([split(t) for t in texts]))
    for t, g, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert g == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False), len(e.ids)), t[:80]


def test_every_character_as_the_library(merges, library):
    split = bpe.Splitter(merges.pattern, merges.special, bpe.unicode_drift())
    encoder = bpe.Encoder(merges, None)
    drift = "".join("".join(x) for x in bpe.unicode_drift().values())
    texts = [f"a{chr(c)}b" for c in range(0x11000) if not 0xAC00 <= c < 0xF900] + [f"a{c}b" for c in drift]
    got = encoder.texts([split(t) for t in texts])
    assert [t for t, g, e in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)) if g[0] != " ".join(map(str, e.ids))] == []


def test_odd_texts_as_the_library(merges, library):
    rng = random.Random(2)
    texts = ["", " ", "\n\n", "it's we'll I'd 'SS", "<|endoftext|>", "a<|startoftext|>B <|endoftext|><|endoftext|>c <|nothing|>", "x" * 3000, "ab" * 5000 + "!" * 1000,
             "ΑΣ ΟΔΟΣ İstanbul ǅ ﬁ Å", "é 가", "日本語のテキスト 12345 ٣٤", "🙂🙂🏽 é" * 20, "'" * 50, "a\u0000b‍c﻿"]
    texts += ["".join(rng.choice("abc'é!1 \t") for _ in range(200)) for _ in range(200)]
    split = bpe.Splitter(merges.pattern, merges.special, bpe.unicode_drift())
    check(bpe.Encoder(merges, None), split, library, texts)
    words = sorted({w for t in texts for w in split.plain(t) if rng.random() < 0.5 and len(w) < 60})
    flat = Lexicon.build({w.encode(): i.tolist() for w, i in zip(words, merges.merge([w.encode() for w in words]))})
    check(bpe.Encoder(merges, Lexicon(flat)), split, library, texts)


def test_long_and_matrix_merging_agree(merges):
    rng = random.Random(4)
    words = ["".join(rng.choice("theinga") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    for w, ids in zip(words, merges.merge(words)):
        assert merges.merge_long(w).tolist() == ids.tolist()


def test_op3_on_the_table(spark, library):
    rows = {r.doc_id: r for r in bpe.op3_transducer_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, e in zip(docs, library.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), sha(" ".join(map(str, e.ids))))
        assert r.decoded_sha256 == sha(library.decode(e.ids, skip_special_tokens=False))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "word " * 50000)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("n_tokens", "word", "n")})
    keep = lambda ids, tokens, n: (n, tokens[:20])
    got = bpe.encode(docs, PATH, keep, "n_tokens long, start string").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 0), (2, 2), (2, 2), (3, 50000)]
    assert bpe.encode(docs.limit(0), PATH, keep, "n_tokens long, start string").count() == 0
