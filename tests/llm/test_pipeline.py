import random

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_near import expected

from wrenchpark.llm import near, quality, repeats, secrets

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_match_brute_force_on_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = P.keep_quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    accepted = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    assert {r.doc_id for r in left.collect()} == accepted and left.columns == docs.columns
    left.write.parquet(f"{tmp_path}/1")
    docs = spark.read.parquet(f"{tmp_path}/1")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    left = P.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in left.collect()} == {i for i, _, _, keep in expected(texts, 5) if keep} and left.columns == docs.columns
    left.write.parquet(f"{tmp_path}/2")
    docs = spark.read.parquet(f"{tmp_path}/2")
    raw = {r.doc_id: r.text.encode() for r in docs.collect()}
    seen = {}
    for b in raw.values():
        for k in range(len(b) - 199):
            seen[b[k:k + 200]] = seen.get(b[k:k + 200], 0) + 1
    left = P.cut_repeats(spark, docs, SF)
    assert left.columns == docs.columns
    for r in left.collect():
        b, gone = raw[r.doc_id], set()
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone.update(range(k, k + 200))
        assert r.text == bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    left.write.parquet(f"{tmp_path}/3")
    docs = spark.read.parquet(f"{tmp_path}/3")
    left = P.mask_secrets(spark, docs, SF)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert secrets.scan(left, secrets.train(docs)).where("size(_hex) + size(_access) > 0").count() == 0
    packed = P.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_null_and_repeated_rows(spark):
    rng = random.Random(0)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(30))
    a = text()
    data = [(1, a), (2, a), (3, text()), (3, text()), (4, None), (None, a), (None, None), (5, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    kept = near.kept(docs)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, None), (True, None)]
    same = [{r.text for r in near.kept(docs.repartition(k)).where("doc_id = 3").collect()} for k in (1, 3, 7)]
    assert len(same[0]) == 1 and same[0] == same[1] == same[2]
    assert kept.dtypes == docs.dtypes
    cut = repeats.remove_repeats(kept)
    done = P.pack(spark, P.mask_secrets(spark, cut, SF), SF)
    assert done.count() >= 6
    for stage in (P.keep_quality, P.drop_near_duplicates, P.cut_repeats, P.mask_secrets, P.pack):
        assert stage(spark, docs.limit(0), SF).count() == 0
