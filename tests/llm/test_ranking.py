import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wrenchpark.llm import ranking as op
from wrenchpark.llm import textnum

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    """Rows of the contract by plain loops; null ids come last."""
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def ordered(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def odd_tables(spark):
    rng = random.Random(7)
    words = "the The of élan naïve 漢字 x1 42 don t under_score a-b Straße STRASSE ÀB àb end".split()
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", "!", "\n", "\x00"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs += [(None, "the the élan"), (None, "of end"), (5, docs[5][1]), (5, docs[5][1]), (7, None), (8, ""), (9, " .,;\x7f"), (10, "end " * 60000), (11, "the"), (12, "the"), (13, "the")]
    items = [(1, "The"), (2, "élan ÉLAN naïve"), (2, "42 x1 x1"), (3, None), (4, ""), (5, "absent words"), (None, "end of 漢字"), (6, "under score b STRASSE"), (7, "the " * 5000 + "End"), (8, "--- \n")]
    return (spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), docs, items)


def test_odd_rows(spark):
    docs, items, d, i = odd_tables(spark)
    clash = {c: F.lit("mine") for c in ("n", "terms", "counts", "item", "score", "rank", "salt", "term", "part")}
    assert rows(op.search(docs.withColumns(clash).repartition(7), items.withColumns(clash))) == ordered(brute(d, i))


def test_several_automata_and_small_steps(spark, monkeypatch):
    """Many small automata, few scores at once and other numbers of results give the same rows."""
    docs, items, d, i = odd_tables(spark)
    monkeypatch.setattr(op, "AUTOMATON_BYTES", 40)
    monkeypatch.setattr(op, "CELLS", 30)
    assert rows(op.search(docs.repartition(3), items, top=3)) == ordered(brute(d, i, 3))
    assert rows(op.search(docs, items, top=1000)) == ordered(brute(d, i, 1000))


def test_no_rows(spark):
    docs, items, *_ = odd_tables(spark)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.where("doc_id = 8"), items), (docs, items.where("item_id = 3"))):
        out = op.search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_scanner_needs_whole_words():
    texts = pa.array(["a ab abc", "ABC,ab;A", "", None, "xab abx éab ab"])
    scan = op.Scanner(["a", "ab", "abc", "éab"])
    total, doc, term, tf = scan(*textnum.utf8(texts))
    assert total.tolist() == [3, 3, 0, 0, 4]
    assert list(zip(doc.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 1), (1, 2, 1), (4, 1, 1), (4, 3, 1)]
    assert op.Scanner([])(*textnum.utf8(texts))[0].tolist() == [3, 3, 0, 0, 4]


def test_parts_are_whole_numbers():
    corpus = op.Corpus(1000, 123456)
    assert corpus.length(np.array([1, 7, 100000])).tolist() == [10 + 90 * n * 1000 // 123456 for n in (1, 7, 100000)]
    assert corpus.weight(1) == math.floor(1000 * math.log(2002 / 3))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({op.ORACLE})").fetchall()
    assert rows(op.op13_aho_corasick_ranking(spark, f"/root/testdata/{sf}")) == ordered(want)
