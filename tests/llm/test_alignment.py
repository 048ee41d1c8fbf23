import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wrenchpark.llm import alignment as op
from wrenchpark.llm.packing import byte_characters

SF = "/root/testdata/sf0.01"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    with open(BYTE, encoding="utf-8") as f, open(PIECE, "rb") as g:
        return op.ByteSide(f.read()), op.PieceSide(g.read())


class Plain:
    """Encoding and alignment by the libraries and two loops."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.back = lambda t: bytes(back[c] for c in t)

    def piece(self, i):
        t = self.b.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, self.back(t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, self.piece(i)) for i in self.b.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def align(self, text):
        """(groups, links) as lists of ids and of pairs of ids."""
        a, b = self.tokens(text)
        groups, links = [], []
        i = j = x = y = 0
        now = ([], [])
        while i < len(a) or j < len(b):
            if x <= y:
                now[0].append(a[i][0])
                x += len(a[i][1])
                i += 1
            else:
                now[1].append(b[j][0])
                y += len(b[j][1])
                j += 1
            if x == y:
                groups.append(now)
                now = ([], [])
        ends_b, at = [], 0
        for _, w in b:
            ends_b.append((at, at + len(w)))
            at += len(w)
        at = k = 0
        for u, w in a:
            while k < len(b) and ends_b[k][1] <= at:
                k += 1
            m = k
            while m < len(b) and ends_b[m][0] < at + len(w):
                links.append((u, b[m][0]))
                m += 1
            at += len(w)
        return len(a), len(b), groups, links


def expected(rows):
    """Contract rows by plain Python, as a list."""
    plain = Plain()
    made = [(r.doc_id, *plain.align(r.text)) for r in rows]
    count = collections.Counter(p for *_, links in made for p in set(links))
    most = collections.Counter()
    for (u, _), c in count.items():
        most[u] = max(most[u], c)
    out = []
    for doc, n_a, n_b, groups, links in made:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def contract(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


ODD = ["", " ", "\n", "a", "  two  spaces \n\n x ", "<|endoftext|> and <s>x</s> <unk>", "▁ is a mark", "漢字 かな 🙂🏽 é é", "\x00\x1c a\x1c  b\x1f c", "foo  bar   baz　  q", "x" * 1500,
       " " * 700 + "end", "it's we'll\tI'd\r\n'SS", "   a   b", "ab " * 3000, "Ελληνικά και русский", "don't" * 200, "﻿ bom", "trailing   ", "𝒳 \U0010ffff"]


def test_gallop():
    rng = np.random.default_rng(0)
    for _ in range(30):
        into = np.sort(rng.choice(1000, rng.integers(0, 300), replace=False))
        want = rng.integers(-5, 1005, 200)
        first = rng.integers(0, len(into) + 1, 200)
        last = np.minimum(first + rng.integers(0, 300, 200), len(into))
        guess = rng.integers(0, 400, 200)
        right = [f + int(np.searchsorted(into[f:t], w)) for w, f, t in zip(want, first, last, strict=True)]
        assert op.gallop(want, into, guess, first, last).tolist() == right


def test_intersection_of_either_side():
    rng = np.random.default_rng(1)
    for _ in range(20):
        short, long, sf, lf = [], [], [0], [0]
        for _ in range(5):
            x, y = np.sort(rng.choice(60, rng.integers(0, 30), replace=False)), np.sort(rng.choice(60, rng.integers(0, 60), replace=False))
            short.append(x)
            long.append(y)
            sf.append(sf[-1] + len(x))
            lf.append(lf[-1] + len(y))
        rank, common = op.intersect(np.concatenate(short), np.array(sf), np.concatenate(long), np.array(lf))
        assert rank.tolist() == [lf[i] + int(np.searchsorted(y, v)) for i, (x, y) in enumerate(zip(short, long, strict=True)) for v in x]
        assert common.tolist() == [v in y for x, y in zip(short, long, strict=True) for v in x]


def test_pieces_as_the_libraries(sides):
    plain = Plain()
    rng = random.Random(5)
    alphabet = "ab'é ß \t\n  \x1c▁漢.1 s"
    texts = [t for t in ODD if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for at in range(0, len(texts), 200):
        part = texts[at:at + 200]
        batch = op.Aligned(part, *sides)
        for i, t in enumerate(part):
            a, b = plain.tokens(t)
            assert batch.a[batch.a_first[i]:batch.a_first[i + 1]].tolist() == [x for x, _ in a], repr(t)
            assert batch.b[batch.b_first[i]:batch.b_first[i + 1]].tolist() == [x for x, _ in b], repr(t)


def test_groups_have_bytes(sides):
    texts = ["Antidisestablishmentarianism, überall!", "", "plain words", "▁"]
    batch = op.Aligned(texts, *sides)
    for i, t in enumerate(texts):
        n_a, n_b, groups, links = Plain().align(t)
        got = batch.groups(i)
        assert [(x, y) for _, _, x, y in got] == groups
        if got:
            assert [g[0] for g in got] == [0, *(g[1] for g in got[:-1])] and got[-1][1] == len(t.encode()) + 1
        mine = batch.doc == i
        assert sorted(zip(batch.a[batch.left[mine]].tolist(), batch.b[batch.right[mine]].tolist(), strict=True)) == sorted(links)


def test_op12_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(contract(op.op12_token_alignment(spark, SF))) == sorted(expected(rows))


def test_blocks_and_odd_rows(spark, monkeypatch):
    """Small blocks, repeated and null ids, many links of one kind, clashing names, and no rows."""
    monkeypatch.setattr(op, "BLOCK_LINKS", 50)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, "a b"), (3, "a b c"), (3, None), (99, " a" * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumns({c: F.lit(1) for c in ("block", "pairs", "n_a", "kind", "places", "documents", "best")})
    got = sorted(((r[0] is None, r[0] or 0, *r[1:]) for r in contract(op.align(docs, BYTE, PIECE, op._digests, "groups_sha256 string"))))
    want = sorted(((r[0] is None, r[0] or 0, *r[1:]) for r in expected(docs.select("doc_id", "text").collect())))
    assert got == want
    assert op.align(docs.limit(0), BYTE, PIECE, op._digests, "groups_sha256 string").count() == 0


def test_links_over_one_byte():
    times = np.array([1, 255, 256, 70000, 3], np.uint32)
    more = op.cut_more(times, np.array([5]))[0].as_py()
    places, n = op.links_of(np.arange(5, dtype="<u4").tobytes(), np.minimum(times, 255).astype(np.uint8).tobytes(), more)
    assert n.tolist() == times.tolist() and places.tolist() == [0, 1, 2, 3, 4]
