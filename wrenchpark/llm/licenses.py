"""Operator 4: license scan by a positional rare-token index, in DataFrame functions only.

Templates are short license notices, each with a mandatory key phrase.

1. One pass over the texts keeps for each row its number of words, the distinct
   license words it has, and the positions of license words that stand next to
   their neighbour in some template.
2. Document frequencies of the license words, over all rows, give their IDF.
   The highest-IDF word of each key phrase is its anchor.
3. Postings meet the templates' postings by word.  Position minus position in
   the template is the place of a possible notice; those of an anchor are
   intersected with the other words' places by grouping.
4. A place counts if every word of the key phrase is there.  For a base phrase
   the template is the phrase itself, so all its places are found.  Other
   templates also need ``COVER`` of their words.

A word is a run of letters and digits with A-Z in lower case, or of characters
beyond ASCII.  Cases: a null or empty text has no words, labels or places and
score 0; null and repeated ids are rows like others; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, table

# What separates words, and the base phrases with their labels.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of the method: text, key phrase in it, label.  No word has a letter that lower() maps to ASCII from beyond it.
NOTICES = (
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lesser general public license", "lgpl"),
    ("gnu affero general public license", "affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "binary forms", "bsd"),
    ("licensed under a creative commons attribution license", "creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unencumbered software", "unlicense"),
)
#: Share of a notice's words that must stand at their places.
COVER = 0.5


def templates() -> list[tuple[int, list[str], int, int, str, bool]]:
    """(number, words, first and last+1 word of the key phrase, label, base)."""
    out = [(t.split(), 0, len(t.split()), label, True) for t, label in BASE.items()]
    for text, key, label in NOTICES:
        words, k = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
        out.append((words, at, at + len(k), label, False))
    return [(i, *t) for i, t in enumerate(out)]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_words, held, postings) of every row."""
    vocabulary = sorted({w for _, words, *_ in templates() for w in words})
    pairs = sorted({f"{a} {b}" for _, words, *_ in templates() for a, b in zip(words, words[1:], strict=False)})
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.filter(F.split(text, SEPARATOR), lambda w: w != "").alias("words"))
    word = lambda i: F.get("words", i)
    beside = lambda w, i: F.concat_ws(" ", w, word(i + 1)).isin(pairs) | F.concat_ws(" ", word(i - 1), w).isin(pairs)
    known = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", known)
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"),
                       F.array_distinct(F.transform("at", word)).alias("held"),
                       F.transform(F.filter("at", lambda i: beside(word(i), i)), lambda i: F.struct(word(i).alias("w"), i.alias("p"))).alias("postings"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    spark = docs.sparkSession
    rows = stage(measured(docs, id_col, text_col), "license-rows")
    # At most one row for each word of the templates.
    seen = {r.w: r.n for r in rows.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = lambda w: -math.log1p(seen.get(w, 0))
    index, about = [], []
    for t, words, a, b, label, base in templates():
        anchor = max(range(a, b), key=lambda i: (idf(words[i]), -i))
        about.append((t, b - a, len(words), label, base, a))
        index += [(w, t, i, a <= i < b, i == anchor) for i, w in enumerate(words)]
    index = spark.createDataFrame(index, "w string, t int, rel int, key boolean, anchor boolean")
    about = spark.createDataFrame(about, "t int, n_key int, n_all int, label string, base boolean, key_at int")
    hits = (rows.select("row", F.explode("postings").alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.p").alias("p"))
            .join(F.broadcast(index), "w").withColumn("off", F.col("p") - F.col("rel")))
    found = (hits.groupBy("row", "t", "off").agg(F.count("*").alias("n"), F.sum(F.col("key").cast("int")).alias("n_here"), F.max("anchor").alias("anchor"))
             .where("anchor").join(F.broadcast(about), "t").where("n_here = n_key")
             .withColumn("cover", F.col("n") / F.col("n_all")).where(F.col("base") | (F.col("cover") >= COVER)))
    mine = lambda c: F.when(F.col("base"), F.col(c))
    sums = found.groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.min(mine("off")).cast("long").alias("first_word"),
        F.max(mine("off")).cast("long").alias("last_word"), F.array_join(F.array_sort(F.collect_set(mine("label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"))
    return rows.select("doc_id", "row", "n_words").join(sums, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op4_rare_token_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels and places in every text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
