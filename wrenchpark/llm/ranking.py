"""Operator 13: ranked lexical search by an Aho-Corasick scan of the documents.

1. The distinct terms of all items are cut by hash into automata of at most
   ``AUTOMATON_BYTES`` bytes of terms each; their number follows from a count, so
   what is broadcast is bounded whatever the items.  A term stands between
   guard bytes, so only whole words match.
2. One scan of the texts for each automaton: bytes between terms become guards,
   A-Z are folded, and the automaton's outputs, the numbers of the terms, are
   counted for each text.  No index of the documents is made.  Staged are, for
   each text, its number of terms and the item terms that it holds with counts.
3. Number of documents, of terms, and of documents with each item term come from
   the staged counts; they weight the terms.
4. Tasks score the staged counts: a term's postings are the items that hold it.
   Each task keeps the best of each item; salted groups and a last grouping leave the
   best ``top``.

A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), all else are 64-bit
integers, see ``Corpus``.

Cases: a null text has no terms, and neither has an item's; rows with the same
item id are one item with the terms of all of them; a null item id is an item like
others; null and repeated document ids are rows like others, nulls behind other
ids of the same score; items without terms, and terms that no document holds,
give no rows; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import arrow_batches, slices, stage, table

TOP = 10
#: Bytes of terms in one automaton, and (term, item) postings that one task scores with.
AUTOMATON_BYTES = 4 << 20
POSTINGS = 2_000_000
#: Groups that a task's results are dealt into before the last grouping of an item.
SALTS = 64
#: Scores that a task holds at once.
CELLS = 4_000_000
GUARD = " "
# Fixed value: what is no term, as the contract states it.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = np.full(256, ord(GUARD), np.uint8)
for _from, _to in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _FOLD[_from:_to + 1] = np.arange(_from, _to + 1)
_FOLD[65:91] += 32


def folded(text):
    """Column: the text with A-Z in lower case and nothing but guards between terms."""
    return F.translate(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), NO_TERM, GUARD),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    words = F.explode(F.split(folded(F.col(text_col)), GUARD))
    return items.select(F.col(id_col).alias("item_id"), words.alias("term")).where("term <> ''").distinct()


class Scanner:
    """Counts of known terms, straight from the bytes of texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        # Bytes as characters, so that positions need no decoding.
        for i, t in enumerate(terms):
            self.automaton.add_word(GUARD + t.encode().decode("latin-1") + GUARD, i)
        self.size = len(terms)
        if terms:
            self.automaton.make_automaton()

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text), and (text, term, count) of each known term in it."""
        n = len(off) - 1
        # A guard before and after every text.
        room = np.full(len(data) + n + 1, ord(GUARD), np.uint8)
        room[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = _FOLD[data]
        edge = off + np.arange(n + 1)
        begins = np.concatenate([[0], np.cumsum((room[1:] != ord(GUARD)) & (room[:-1] == ord(GUARD)))])
        total = np.diff(begins[edge])
        if not self.size:
            z = np.zeros(0, np.int64)
            return total, z, z, z
        whole = room.tobytes().decode("latin-1")
        found, size = [], []
        for a, b in zip(edge[:-1].tolist(), (edge[1:] + 1).tolist(), strict=True):
            hits = [i for _, i in self.automaton.iter(whole[a:b])]
            found += hits
            size.append(len(hits))
        key, tf = np.unique(np.repeat(np.arange(n), size) * self.size + np.array(found, np.int64), return_counts=True)
        return total, key // self.size, key % self.size, tf


def scanned(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): each text's number of terms, the numbers of the known ones in it and how often they occur."""
    arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for b in slices(batches, "text"):
            scan = scan or Scanner(sent.value)
            total, doc, term, tf = scan(*textnum.utf8(b.column(1)))
            cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(term, pa.int32())),
                                              pa.ListArray.from_arrays(cut, pa.array(tf, pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, terms array<int>, counts array<int>")


@dataclass(frozen=True)
class Corpus:
    """Number of documents with a term, and of their terms.  All divisions round down."""
    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def length(self, n: np.ndarray) -> np.ndarray:
        return 10 + 90 * n * self.documents // max(self.terms, 1)

    @staticmethod
    def part(weight: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return weight * (1_000_000_000 * tf // (1000 * tf + 8 * length))


def _frequencies(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_terms, np.int64)
        for b in batches:
            count += np.bincount(np.asarray(b.column(0).flatten()), minlength=n_terms)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], names=["term", "df"])
    return run


def _scores(corpus: Corpus, weight: np.ndarray, start: np.ndarray, items: np.ndarray, n_items: int, top: int):
    """Partial results of a task: (item, doc_id, score), the best ``top`` of each item."""
    def best(item: np.ndarray, score: np.ndarray, doc: pa.Array) -> np.ndarray:
        # Order by item, score downwards, id upwards with nulls last.
        order = np.asarray(pc.sort_indices(pa.table({"i": item, "s": score, "d": doc}), sort_keys=[("i", "ascending"), ("s", "descending"), ("d", "ascending")], null_placement="at_end"))
        i = item[order]
        first = np.searchsorted(i, i)
        return order[np.arange(len(i)) - first < top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        step = max(1, CELLS // max(n_items, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                terms, tf = np.asarray(b.column(2).flatten(), np.int64), np.asarray(b.column(3).flatten(), np.int64)
                doc = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column(2)), np.int64))
                part = Corpus.part(weight[terms], tf, corpus.length(np.asarray(b.column(1), np.int64))[doc])
                many = start[terms + 1] - start[terms]
                ends = np.cumsum(many)
                place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[terms] - (ends - many), many)
                # Sums stay below 2^53, so doubles hold them exactly: a part is below 10^11.
                cell = np.bincount(np.repeat(doc, many) * n_items + items[place], np.repeat(part, many).astype(np.float64), b.num_rows * n_items)
                hit = np.flatnonzero(cell > 0)
                item, row, score = hit % n_items, hit // n_items, cell[hit].astype(np.int64)
                ids = b.column(0).take(pa.array(row))
                if held is not None:
                    item, score, ids = np.concatenate([held[0], item]), np.concatenate([held[1], score]), pa.concat_arrays([held[2], ids])
                keep = best(item, score, ids)
                held = item[keep], score[keep], ids.take(pa.array(keep))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), held[2], pa.array(held[1], pa.int64())], names=["item", "doc_id", "score"])
    return run


def _top(df: DataFrame, by: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best rows of ``docs`` for each item with a score above 0."""
    spark = docs.sparkSession
    terms = stage(item_terms(items, item_col, item_text_col), "ranking-terms")
    size = terms.agg(F.countDistinct("term").alias("n"), F.sum(F.octet_length("term")).alias("bytes"), F.count(F.lit(1)).alias("postings"),
                     F.count_distinct(F.struct("item_id")).alias("items")).first()
    # Parts of items: each with its own automaton and its own result, so that no broadcast grows with the items.
    # Twice the mean leaves room for uneven hashes.
    parts = max(1, math.ceil(2 * (size.bytes or 0) / AUTOMATON_BYTES), math.ceil(2 * size.postings / POSTINGS))
    own = terms if parts == 1 else stage(terms.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))), "ranking-parts")
    out = [_search_part(docs, own if parts == 1 else own.where(F.col("part") == p).drop("part"), top, id_col, text_col, items.schema[item_col].dataType) for p in range(parts)]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result if size.postings else spark.createDataFrame([], result.schema)


def _search_part(docs: DataFrame, terms: DataFrame, top: int, id_col: str, text_col: str, item_type) -> DataFrame:
    spark = docs.sparkSession
    got = terms.toArrow()
    names, term = np.unique(np.array(got.column("term").to_pylist(), object), return_inverse=True) if got.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    ids = got.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode") if got.num_rows else None
    item = np.asarray(ids.indices, np.int64) if ids is not None else np.zeros(0, np.int64)
    n_items = len(ids.dictionary) if ids is not None else 0
    order = np.argsort(term, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int64)

    found = stage(scanned(docs, names.tolist(), id_col, text_col), "ranking-counts")
    whole = found.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    corpus = Corpus(whole.documents, whole.terms)
    df = np.zeros(len(names), np.int64)
    for r in found.select("terms").mapInArrow(_frequencies(len(names)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    weight = np.array([corpus.weight(int(x)) for x in df], np.int64)
    sent = spark.sparkContext.broadcast((weight, start, item[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scores(corpus, *sent.value, n_items, top)(batches)

    kind = docs.schema[id_col].dataType.simpleString()
    partial = found.mapInArrow(run, f"item int, doc_id {kind}, score long")
    few = _top(partial.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), ["item", "salt"], top).drop("salt", "rank")
    best = _top(few, ["item"], top)
    known = spark.createDataFrame(pa.table({"item": pa.array(range(n_items), pa.int32()), "item_id": ids.dictionary if ids is not None else pa.array([], pa.int64())}))
    # One row for each item of this part.
    return best.join(F.broadcast(known), "item").select(F.col("item_id").cast(item_type).alias("item_id"), "rank", "doc_id", "score")


def op13_aho_corasick_ranking(spark, sf_dir: str) -> DataFrame:
    """The ten best rows of ``documents`` for each row of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), item_words AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), counts AS (
  SELECT r, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM item_words) GROUP BY ALL
), sizes AS (
  SELECT r, count(*) AS n FROM words GROUP BY r
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, corpus GROUP BY term, docs
), parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS part
  FROM counts JOIN sizes USING (r) JOIN weights USING (term), corpus
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts JOIN item_words USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
