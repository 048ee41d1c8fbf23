"""Operator 1: exact substring dedup.

Every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere in
the corpus, the same document included, is removed.

1. Each window of WIDTH bytes has an anchor: the substring of ``GRAM`` bytes
   with the smallest hash in it.  Windows in a row with one anchor form a block,
   about one for each 50 bytes.  Equal windows have equal anchors.
2. Blocks whose anchor occurs once in the corpus hold no repeated window.  The
   others meet by anchor: blocks with equal bytes are repeated as a whole, and
   one of each kind stands for all.
3. Kinds that share an anchor but not all bytes, the ends of repeated passages,
   are solved by suffix arrays (``suffixes``): a window is repeated if a
   neighbour in the order has the same WIDTH bytes.
4. Anchors with over ``MOST_KINDS`` kinds would be too much for one task.  Their
   windows are grouped by digest, one row each, with the same result.
5. The windows found go back to all members of their kind, are merged to spans
   for each document and cut out.

A document is known by its id and a hash of its text, so that ids may repeat.

Cases: a null or empty text, or one of fewer than WIDTH bytes, loses nothing;
repeated rows are documents of their own and repeat each other; null ids are
ids like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import arrow_batches, slices, stage, table, unstage
from .groups import complete_groups
from .suffixes import repeated_windows

WIDTH = 200
GRAM = 100
MOST_KINDS = 2000
#: Bytes of text that a task cuts into blocks at once; its arrays take some hundred times as many.
SLICE = 1 << 19


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: of the tail of one stretch of w and the head of the next."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:len(x)] = x
    rows = full.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1:w - 1 + n])


def blocks_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, anchor hash, content hash) of all blocks of a batch of texts."""
    n = len(data) - WIDTH + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    pre = textnum.prefix(textnum.BYTE[data])
    at = np.arange(len(data) - GRAM + 1)
    gram = textnum.spans_hash(pre, at, at + GRAM)
    bits = np.uint64(int(len(at)).bit_length())
    low = sliding_minimum(((gram >> bits) << bits) | at.astype(np.uint64), WIDTH - GRAM + 1)
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    at = at[:n]
    valid = at + WIDTH <= off[doc + 1]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    # A block ends where the next begins or where windows stop being whole.
    stop = np.append(np.flatnonzero(new[1:] | (valid[:-1] & ~valid[1:])) + 1, n)
    last = stop[np.searchsorted(stop, first, side="right")]
    content = textnum.spans_hash(pre, first, last - 1 + WIDTH)
    return doc[first], first - off[doc[first]], last - first, gram[anchor[first]].view(np.int64), content.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SLICE):
        doc, start, n, anchor, content = blocks_of(*textnum.utf8(b.column(2)))
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(start.astype(np.int32)),
                                          pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content)],
                                         names=["doc_id", "th", "start", "n", "a", "c"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in complete_groups(batches, "a"):
        flags = repeated_windows(t.column("bytes").to_pylist(), WIDTH)
        size = np.array([len(f) for f in flags])
        some = np.concatenate(flags) if len(flags) else np.zeros(0, bool)
        block = np.repeat(np.arange(len(flags)), size)
        first = np.cumsum(size) - size
        new, stop = some.copy(), some.copy()
        edge = np.diff(block) != 0
        new[1:] &= ~some[:-1] | edge
        stop[:-1] &= ~some[1:] | edge
        begin, end = np.flatnonzero(new), np.flatnonzero(stop) + 1
        # A kind with several members is repeated as a whole anyway.
        open_ = t.column("alone").to_numpy()[block[begin]]
        begin, end = begin[open_], end[open_]
        own = pa.array(block[begin])
        yield pa.RecordBatch.from_arrays(
            [t.column("a").combine_chunks().take(own), t.column("c").combine_chunks().take(own),
             pa.array((begin - first[block[begin]]).astype(np.int32)), pa.array((end - first[block[begin]]).astype(np.int32))], names=["a", "c", "i", "j"])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.hash(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, spans) of documents that hold repeated windows; spans of (s, e) may overlap."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = _documents(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = stage(texts.mapInArrow(_blocks, f"doc_id {kind}, th int, start int, n int, a long, c long"), "repeat-blocks")
    again = stage(blocks.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "repeat-anchors")
    members = stage(blocks.join(again, "a", "left_semi"), "repeat-members")
    unstage(blocks, again)
    kinds = stage(members.groupBy("a", "c").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "th", "start")).alias("one"), F.min("n").alias("n")), "repeat-kinds")
    mixed = kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1")
    # One member of each kind of a mixed anchor lends its bytes.
    asked = (kinds.join(mixed, "a").groupBy("one.doc_id", "one.th")
             .agg(F.collect_list(F.struct("a", "c", "kinds", "n", (F.col("k") == 1).alias("alone"), F.col("one.start").alias("start"))).alias("asked"))
             .select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "asked"))
    raw = F.col("text").cast("binary")
    lent = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select(F.explode(F.transform(
        "asked", lambda x: F.struct(x["a"].alias("a"), x["c"].alias("c"), x["kinds"].alias("kinds"), x["n"].alias("n"), x["alone"].alias("alone"),
                                    F.substring(raw, x["start"] + 1, x["n"] + (WIDTH - 1)).alias("bytes")))).alias("x")).select("x.*")
    # Rows that share id and text lend the same bytes.
    lent = stage(lent.dropDuplicates(["a", "c"]), "repeat-lent")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usual = (lent.where(F.col("kinds") <= MOST_KINDS).select("a", "c", "alone", "bytes").repartition(n_parts, "a").sortWithinPartitions("a")
             .mapInArrow(_solve, "a long, c long, i int, j int"))
    windows = lent.where(F.col("kinds") > MOST_KINDS).select("a", "c", "alone", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.md5(F.substring("bytes", i + 1, WIDTH)).alias("h")))).alias("x"))
    windows = windows.select("a", "c", "alone", "x.i", "x.h")
    often = stage(windows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "repeat-often")
    many = windows.where("alone").join(often, "h", "left_semi").select("a", "c", "i", (F.col("i") + 1).alias("j"))
    whole = kinds.where("k > 1").select("a", "c", F.lit(0).alias("i"), F.col("n").alias("j"))
    found = stage(whole.union(usual).union(many).groupBy("a", "c").agg(F.collect_list(F.struct("i", "j")).alias("w")), "repeat-found")
    spans = members.join(found, ["a", "c"]).select("doc_id", "th", F.transform(
        "w", lambda x: F.struct((F.col("start") + x["i"]).alias("s"), (F.col("start") + x["j"] + (WIDTH - 1)).alias("e"))).alias("spans"))
    return spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans, those that touch joined."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return begin[at], reach[np.append(at[1:], len(begin)) - 1]


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spans = repeated_spans(docs, id_col, text_col).select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.col("spans").alias("__spans"))
    key = F.hash(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(spans, F.col(id_col).eqNullSafe(F.col("__d")) & (key == F.col("__h")), "left").drop("__d", "__h")


def _kept(text: bytes, spans: np.ndarray, offset: int, size: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed spans."""
    if not size:
        return text, 0
    s, e = merged(spans[0][offset:offset + size], spans[1][offset:offset + size])
    at = [0, *e.tolist()]
    to = [*s.tolist(), len(text)]
    return b"".join([text[a:b] for a, b in zip(at, to, strict=True)]), len(s)


def _cuts(b: pa.RecordBatch, text: str) -> Iterator[tuple[bytes, bytes, int]]:
    column = b.column(b.schema.get_field_index("__spans"))
    flat = column.flatten()
    ends = (flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)) if len(flat) else (np.zeros(0, np.int64),) * 2
    size = np.array([x or 0 for x in column.value_lengths().to_pylist()], np.int64)
    offset = np.cumsum(size) - size
    for raw, o, n in zip(b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist(), offset.tolist(), size.tolist(), strict=True):
        yield raw or b"", *_kept(raw or b"", ends, o, n)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts; what is left of a cut character goes too."""
    rows = _with_spans(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            new = [None if old is None else left.decode("utf-8", "ignore")
                   for old, (_, left, _) in zip(b.column(at).to_pylist(), _cuts(b, text_col), strict=True)]
            cols = [pa.array(new, pa.string()) if name == text_col else b.column(i) for i, name in enumerate(b.schema.names) if name != "__spans"]
            yield pa.RecordBatch.from_arrays(cols, names=[c for c in b.schema.names if c != "__spans"])

    return rows.mapInArrow(run, docs.schema)


def op1_lyndon_suffixes(spark, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes take from each of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cuts = [(len(old), len(old) - len(left), n, hashlib.sha256(left).hexdigest()) for old, left, n in _cuts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*cuts, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
