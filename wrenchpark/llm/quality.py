"""Operator 10: quality classifier, histogram gradient-boosted trees over document statistics.

One pass over the texts computes a fixed number of statistics for each row.
Trees are trained on the driver on a bounded sample of labelled rows: the
``SAMPLE_ROWS`` with the smallest hash of their id, and never a held-out one.
The fitted trees, a few flat arrays, travel to the tasks, which walk them with
numpy for a whole batch at a time.

Only the text is an input of a score: no id, language, source or label.

Cases: a null text counts as empty, and empty texts get the score that the
trees give to all-zero statistics; null and repeated ids are rows like others
(a null id is never held out nor trained on); several labels of one id are
averaged, null labels are left out; without labels every score is 0.5, with one
class only every score is near that class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, textnum
from .common import arrow_batches, slices, stage, table

#: Bytes of text that a task measures at once; its arrays take some ninety times as many.
SLICE = 1 << 19
#: Most labelled rows that the trees are trained on.
SAMPLE_ROWS = 20_000
#: Rows whose id's CRC-32 leaves this remainder modulo FOLDS are held out.
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True

FEATURES = ("log_bytes", "lower", "upper", "digit", "space", "newline", "punct", "other", "entropy", "top_byte",
            "top_punct", "bar", "words", "word_length", "word_spread", "long_words", "short_words", "distinct_words",
            "repeated_next", "upper_words", "title_words", "digit_words", "punct_ends", "stop_ends", "lines",
            "line_words", "distinct_lines", "punct_run")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


def statistics(col: pa.Array) -> np.ndarray:
    """(rows, features) of the texts of one batch."""
    data, off = textnum.utf8(col)
    n = len(off) - 1
    size = np.diff(off).astype(float)
    doc = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
    s, e, d = textnum.words(data, off)
    count = np.bincount(d, minlength=n).astype(float)
    per_doc = lambda flags: _ratio(np.bincount(d, flags, n), count)
    length = (e - s).astype(float)
    if len(s):
        h = textnum.spans_hash(textnum.prefix(textnum.BYTE[textnum.LOWER[data]]), s, e)
        first, final = data[s], data[e - 1]
        ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        puncts = np.concatenate([[0], np.cumsum(_PUNCT[data])])
        upper, digit, punct = ups[e] - ups[s], digits[e] - digits[s], puncts[e] - puncts[s]
        distinct = _distinct(d, h, n)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    else:
        h, first, final = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        upper = digit = punct = same = np.zeros(0)
        distinct = np.zeros(n)
    # Lines: the words between two line feeds, by the running number of line feeds before each word.
    feed = np.concatenate([[0], np.cumsum(data == 10)])
    line = feed[s] if len(s) else np.zeros(0, np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (line[1:] != line[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    if len(begin):
        pre = textnum.prefix(h)
        line_hash = textnum.spans_hash(pre, begin, np.append(begin[1:], len(s)))
        lines = np.bincount(d[begin], minlength=n).astype(float)
        distinct_lines = _distinct(d[begin], line_hash, n)
    else:
        lines = distinct_lines = np.zeros(n)
    mean = per_doc(length)
    spread = np.sqrt(np.maximum(per_doc(length ** 2) - mean ** 2, 0))
    part = lambda mask: p[:, mask].sum(axis=1)
    return np.stack([
        np.log1p(size), part(_LOWER), part(_UPPER), part(_DIGIT), p[:, 32], p[:, 10], part(_PUNCT),
        p[:, 128:].sum(axis=1), entropy, p.max(axis=1), p[:, _PUNCT].max(axis=1), p[:, 124], np.log1p(count),
        mean, spread, per_doc(length > 12), per_doc(length < 3), _ratio(distinct, count), per_doc(same),
        per_doc((upper > 1) & (upper * 2 > length)), per_doc(_UPPER[first]), per_doc(digit > 0),
        per_doc(_PUNCT[final]), per_doc(_STOP[final]), np.log1p(lines), _ratio(count, lines),
        _ratio(distinct_lines, lines), per_doc(punct > 1)], axis=1)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    a, b = doc[order], h[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.bincount(a[new], minlength=n).astype(float)


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, with the statistics of their texts."""
    for b in slices(batches, column, SLICE):
        yield b, statistics(b.column(b.schema.get_field_index(column))).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, x in _sliced(batches, "text"):
        stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        rest = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("text", "stats")]
        yield pa.RecordBatch.from_arrays([*rest, stats], names=[*(c for c in b.schema.names if c not in ("text", "stats")), "stats"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, stats) of every row."""
    arrow_batches(docs.sparkSession)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_measure, f"{schema}, stats array<float>")


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> boosting.Model:
    """Trees from a bounded, fixed sample of labelled rows that are not held out."""
    known = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("id"))
             .agg(F.avg(F.col(label_col).cast("double")).alias("y")))
    rows = stats.where("not held_out").dropDuplicates(["doc_id"]).join(known, F.col("doc_id") == F.col("id"))
    got = (rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("stats", "y").toArrow())
    if not got.num_rows:
        return boosting.constant(0.5)
    x = np.asarray(got.column("stats").combine_chunks().flatten(), np.float64).reshape(got.num_rows, len(FEATURES))
    return boosting.fit(x, np.asarray(got.column("y"), np.float64))


def scored(stats: DataFrame, model: boosting.Model) -> DataFrame:
    """``stats`` with a column ``score`` in place of the statistics."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(b.schema.get_field_index("stats")).flatten(), np.float64).reshape(b.num_rows, len(FEATURES))
                keep = [i for i, name in enumerate(b.schema.names) if name not in ("stats", "score")]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(sent.value.score(x))],
                                                 names=[*(b.schema.names[i] for i in keep), "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name not in ("stats", "score"))
    return stats.mapInArrow(score, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text", accept: float = ACCEPT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    stats = stage(measured(docs, id_col, text_col), "quality-stats")
    model = train(stats, labels, label_col, sample_rows)
    return scored(stats, model).withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
             accept: float = ACCEPT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = train(stage(measured(docs, id_col, text_col), "quality-stats"), labels, label_col, sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _sliced(batches, text_col):
            yield b.filter(pa.array(sent.value.score(x.astype(np.float64)) >= accept))

    return docs.mapInArrow(keep, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``, learned from ``labels.quality``."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
