import hashlib
import random
import re

from pyspark.sql import functions as F

from wrenchpark.llm import licenses, secrets

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def check_secrets(rows, texts):
    for r in rows:
        base = base_spans(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == digest(base)
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for s, _, e, k in base} <= set(spans)
        order = [(int(s), secrets.KINDS.index(k)) for k, s, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)


def result(docs, model):
    found = secrets.scan(docs, model)
    return found.select("doc_id", *(F.size(f"_{k}").alias(f"n_{k}") for k in secrets.KINDS[:3]),
                        F.sha2(secrets._joined(secrets.KINDS[:3]).cast("binary"), 256).alias("base_sha256"), secrets._joined(secrets.KINDS).alias("spans")).collect()


def test_op9_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = secrets.op9_markov_secrets(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    check_secrets(rows, texts)
    # Ordinary words of the corpus, however long, are no random strings.
    assert sum("random" in r.spans for r in rows) <= 2


def test_patterns_random_runs_and_masking(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    planted = [key(40) for _ in range(20)]
    texts = {i: f"the internationalconfiguration international é {k} transformation" for i, k in enumerate(planted)}
    words = ["transformation", "configuration", "international", "identifier_of_request", "relationships", "responsibilities"]
    texts |= {100 + i: " ".join(rng.choice(words) for _ in range(60)) + f' token = "{"%040x" % rng.getrandbits(160)}"' for i in range(40)}
    texts |= {200: 'é𝒳 PassWord: "abcdefgh" api-key api_key=short apikey="longer.value_1=" token:token: abcdefgh', 201: "AKIA" + "A" * 12 + " AKIAAKIAAKIAAKI AKIA" + "Z" * 40,
              202: "f" * 19 + " " + "0" * 32 + "g" + "a" * 33 + "A", 203: None, 204: "", 207: "f" * 31 + " " + "0" * 31, 205: "secret=" + "x" * 200000, 206: "K token = 12345678 ſecret = 12345678"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "token", "label", "cell")})
    model = secrets.train(docs)
    rows = result(docs, model)
    assert len(rows) == len(texts)
    check_secrets(rows, texts)
    spans = {r.doc_id: r.spans for r in rows}
    for i, k in enumerate(planted):
        at = texts[i].index(k)
        assert spans[i] == f"random:{at}:{at + len(k)}"
    clean = {r.doc_id: r.text for r in secrets.masked(docs, model).collect()}
    assert clean[0] == texts[0].replace(planted[0], secrets.MASK)
    assert clean[202] == "f" * 19 + " [SECRET]g[SECRET]A" and clean[203] is None and clean[204] == ""
    assert clean[201] == "[SECRET] AKIAAKIAAKIAAKI [SECRET]" and clean[205] == secrets.MASK
    assert secrets.masked(docs, model).columns == docs.columns
    assert result(docs.limit(0), secrets.train(docs.limit(0))) == []


def test_clean_runs_are_not_random(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = secrets.train(docs)
    clean = ["-" * 30, "=" * 40, "_" * 25, "src/main/java/com/example/service/UserService", "/en/products/category/item-name", "state-of-the-art-technology",
             "/usr/local/share/documentation", "12345678901234567890", "2024-01-31/2024-02-29/001", "----------------------aB", "a-b-c-d-e-f-g-h-i-j-k-l", "a_long_name_of_some_function"]
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET) for _ in range(n))
    keys = [key(40) for _ in range(60)] + ["%s-%s-%s" % tuple("%08x" % rng.getrandbits(32) for _ in range(3)) for _ in range(10)]
    texts = dict(enumerate([f"see {x} there" for x in clean + keys]))
    rows = {r.doc_id: r.spans for r in result(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model)}
    assert {x: rows[i] for i, x in enumerate(clean) if rows[i]} == {}
    assert [x for i, x in enumerate(keys, len(clean)) if rows[i] != f"random:4:{4 + len(x)}"] == []


def test_every_row_trains_the_ordinary_model(spark):
    # The words of one rare source in 4,000 rows, whatever its id, are ordinary.
    texts = [(i, "plain words of the corpus") for i in range(4000)]
    rare = "XqzWvkQxjZwqVkxQ"
    for lone in (17, None):
        docs = spark.createDataFrame([(i, t) if i != 17 else (lone, f"{rare} " * 3000) for i, t in texts], "doc_id long, text string")
        found = secrets.scan(spark.createDataFrame([(1, f"{rare}{rare}")], "doc_id long, text string"), secrets.train(docs))
        assert found.select(F.size("_random")).first()[0] == 0


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def check_licenses(rows, texts):
    for r in rows:
        w = words_of(texts[r.doc_id])
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op4_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = licenses.op4_rare_token_licenses(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 0
    check_licenses(rows, texts)
    for r in rows:
        if "released under the mit license" in (texts[r.doc_id] or "").lower():
            assert "mit" in r.labels.split(",")


def test_license_places_and_odd_rows(spark):
    texts = {1: "CC BY cc-by 4.0; cc by", 2: None, 3: "", 4: "All Rights\n\nReserved. all rights all rights reserved", 5: "license general public license GENERAL public License",
             6: "é" + "cc by", 7: "cc by" + "É", 8: "by cc all right reserved", 9: "cc " * 30000 + "by", 10: " ... ",
             11: "Licensed under the Apache License, Version 2.0.", 12: "apache license version 9", 13: "GNU Lesser General Public License", 14: "cc by cc by"}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "words", "at", "t", "w", "n_words", "label")})
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) + 1
    check_licenses(rows, texts)
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[11] == "apache-2.0" and labels[12] == "" and labels[13] == "gpl,lgpl"
    null = licenses.scan(spark.createDataFrame([(None, "cc by")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_base, r.labels) for r in null] == [(None, 1, "cc-by")]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_a_text_with_very_many_matches(spark):
    """Places and masks of 40,000 matches in one text, and no column of the caller's is lost."""
    import time
    n = 40_000
    rows = [(1, "token=abcdefgh12 " * n, "kept"), (2, "é token=abcdefgh12 " * 300, "too"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _assign string").withColumns({c: F.lit(c) for c in ("_spans", "_row", "_random", "_text")})
    warm = lambda df: df.select(F.size(secrets.places(F.col("text"), secrets.ASSIGN, 2)).alias("n"), F.element_at(secrets.places(F.col("text"), secrets.ASSIGN, 2), -1).alias("x"))
    warm(docs.where("doc_id = 2")).collect()
    began = time.time()
    got = warm(docs.where("doc_id = 1")).first()
    assert time.time() - began < 10 and (got.n, got.x.s, got.x.e) == (n, 17 * n - 17, 17 * n - 1)
    out = {r.doc_id: r for r in secrets.masked(docs, [0.0] * secrets.SIDE ** 2).collect()}
    assert out[1].text == "[SECRET] " * n and out[2].text == "é [SECRET] " * 300 and out[3].text is None
    assert out[1].asDict() | {"text": ""} == {"doc_id": 1, "text": "", "_assign": "kept", "_spans": "_spans", "_row": "_row", "_random": "_random", "_text": "_text"}
