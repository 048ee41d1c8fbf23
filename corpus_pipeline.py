"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each result as Parquet and
reads it again for the next stage.

1. quality: rows that the classifier rejects go.
2. near_duplicates: of each group linked by shingles of five words one row
   stays, the one with the smallest id.
3. repeats: strings of 200 bytes that occur more than once are cut out, and
   ``n_chars`` follows.
4. secrets: found spans are masked, and ``n_chars`` follows.
5. packing: what is left becomes pieces of sequences of 1024 tokens.

Rows with a null id pass stages 1 to 4 like others.  Of rows with the same id
stage 2 keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenchpark.llm import near, packing, quality, repeats, secrets
from wrenchpark.llm.common import stage, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.kept(docs, words=5)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(repeats.remove_repeats(docs))


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secrets.masked(docs, secrets.train(docs)))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("secrets", mask_secrets), ("packing", pack)]
#: SQL cannot express the trained and the chosen-path stages.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
