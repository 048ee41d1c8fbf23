import collections
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenchpark.llm import fertility as op

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.fixture(scope="module")
def vocabularies():
    out = []
    for p in op.public_vocabularies():
        with open(p, "rb") as f:
            out.append(op.Vocabulary(p, f.read()))
    return out


def counts(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def measures(v, text):
    """(tokens, characters per token, byte share, entropy), each word encoded alone."""
    w = WORD.findall(text)
    ids = [i for e in (v.encode(w) if w else []) for i in e]
    n = max(len(ids), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())
    return len(ids), sum(map(len, w)) / n, sum(bool(v.single[i]) for i in ids) / n, entropy


def verdicts(rows):
    """Bands and verdicts by plain Python; rows are (lang, counts, measures of each vocabulary)."""
    fails = [c[0] < 20 or 100 * c[4] > 30 * c[0] for _, c, _ in rows]
    groups = collections.defaultdict(list)
    for lang, per in {(r[0], r[2]) for r, f in zip(rows, fails, strict=True) if not f}:
        for i, (n, *m) in enumerate(per):
            for name, x in zip(op.MEASURES, m, strict=True):
                for c in (int(math.log2(max(n, 1))), -1):
                    groups[name, i, lang, c].append(math.floor(x / op.STEP + 0.5) * op.STEP)
    band = {}
    for k, xs in groups.items():
        if len(xs) >= op.LEAST_ROWS:
            mid = statistics.median(xs)
            band[k] = mid, 1.4826 * statistics.median([abs(x - mid) for x in xs])
    out = []
    for (lang, _, per), f in zip(rows, fails, strict=True):
        bad = []
        for i, (n, *m) in enumerate(per):
            for name, x in zip(op.MEASURES, m, strict=True):
                low, high = op.OUTER[name]
                b = band.get((name, i, lang, int(math.log2(max(n, 1))))) or band.get((name, i, lang, -1))
                if b:
                    reach = op.WIDTH * max(b[1], op.LEAST_SPREAD[name] / math.sqrt(max(n, 1)))
                    low, high = (low if name == "byte_share" else b[0] - reach), b[0] + reach
                if not low <= x <= high:
                    bad.append(f"{name}_{i}")
        out.append((f, bad, not f and not bad))
    return out


def test_op11_against_brute_force(spark, vocabularies):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(d.lang, counts(d.text or ""), tuple(measures(v, d.text or "") for v in vocabularies)) for d in docs]
    want = {d.doc_id: (r, v) for d, r, v in zip(docs, rows, verdicts(rows), strict=True)}
    got = op.op11_tokeniser_fertility(spark, SF).collect()
    assert len(got) == len(docs)
    for g in got:
        (_, c, per), (failed, bad, kept) = want[g.doc_id]
        assert tuple(g[x] for x in COUNTS) == c
        for i, m in enumerate(per):
            assert (g[f"tokens_{i}"], *(g[f"{x}_{i}"] for x in op.MEASURES)) == pytest.approx(m)
        assert (g.base_failed, g.outside, g.kept) == (failed, bad, kept)
    assert any(g.outside for g in got if not g.base_failed)


def test_bands_hold_against_labels(spark):
    """Clean rows stay; rows labelled as poor that pass the plain rules mostly go."""
    got = op.op11_tokeniser_fertility(spark, "/root/testdata/sf0.1").where("not base_failed")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rate = {r.quality: r.kept for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.2


def odd_rows(spark):
    rng = random.Random(1)
    plain = " ".join(rng.choice("the of and quick brown fox jumps over lazy dogs while rivers run".split()) for _ in range(40))
    rows = [(1, None, "en"), (2, "", None), (2, " \n\t\r", ""), (None, plain, "en"), (None, plain, "en"), (3, "слово " * 30, None), (4, "漢字文 かな " * 4, None),
            (5, "one two three four five six seven eight " * 4000, "en"), (6, "a\n\nb\na \na\n\x00\n", "xx"), (7, "#*$%&|<> é🙂   x", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_odd_rows(spark, vocabularies):
    docs = odd_rows(spark).withColumns({c: F.lit("mine") for c in ("n_words", "_lang", "class", "kept", "outside", "tokens_0")})
    got = op.quality_rules(docs).collect()
    assert len(got) == 10
    by = collections.defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
    for r in odd_rows(spark).collect():
        assert counts(r.text or "") in [tuple(g[x] for x in COUNTS) for g in by[r.doc_id]]
    assert {g.lang for g in by[2]} == {"none"} and by[3][0].lang == "cyrillic" and by[4][0].lang == "han"
    assert by[None][0] == by[None][1] and by[None][0].kept
    assert not any(g.kept for g in by[1] + by[2] + by[5])
    assert op.quality_rules(docs.limit(0)).count() == 0


def test_few_rows_take_the_outer_bounds(spark):
    rng = random.Random(3)
    junk = " ".join("".join(rng.choice("ÿกἀʘ") for _ in range(9)) for _ in range(30))
    got = {r.doc_id: r for r in op.quality_rules(spark.createDataFrame([(1, junk, "en"), (2, "plain words in a row make up this text and so it goes on and on until twenty of them are there", "en")], "doc_id long, text string, lang string")).collect()}
    assert not got[1].kept and any(c.startswith("byte_share") for c in got[1].outside)
    assert got[2].kept


def test_copies_do_not_make_a_band(spark):
    """Three times as many copies of one text as there are other texts leave the verdicts on the others alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'en'").orderBy("doc_id").limit(1)
    copies = spark.range(3000).join(one.select("text", "lang")).select((F.col("id") + 10**6).alias("doc_id"), "text", "lang")
    before = {r.doc_id: r.kept for r in op.quality_rules(docs).collect()}
    after = {r.doc_id: r.kept for r in op.quality_rules(docs.union(copies)).where("doc_id < 1000000").collect()}
    assert before == after


def test_ragged():
    assert op.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert op.ragged(np.zeros(0, int), np.zeros(0, int)).tolist() == []
