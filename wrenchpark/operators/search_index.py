"""Contains-search over a stored table by trigram postings.

A plain contains-search reads every text of every row.  Here two tables are
written next to each other:

* ``rows``: the table itself in ``block=`` folders of ``BLOCK`` ids.
* ``postings``: for each search column and each three characters in a row of its
  lower-case text (a *gram*), the ids of the rows that hold it, as arrays of places
  in an id block, so that no array grows with the table.  They are made from the stored
  rows, a block at a time, so only finished arrays are shuffled.  They are dealt into
  ``bucket=`` folders by a hash of the gram and sorted by it, so a search reads a few
  folders and skips most row groups in them.

A search takes the literal runs of its pattern (between ``%``, ``_`` and sets).
Their grams must all be in one column of a row, so their posting arrays are
intersected block by block.  What is left are candidates; the blocks that hold any
are read and every candidate is verified by the same LIKE predicate as the plain
search, so the result is the same.  A pattern without three literal characters
in a row has no gram and is searched plainly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import search_predicate
from ..sources.tables import read_folders, write_folders

GRAM = 3
#: Ids in one block, and folders of postings.
BLOCK = 1 << 16
BUCKETS = 64
#: Blocks of a bucket that are written by one task, and tasks of a bucket at most.
SPREAD, WRITERS = 32, 8
#: Rows and text bytes whose grams are listed at once; a block with more has several arrays for a gram.
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 32 << 20
_PLACEHOLDER = re.compile(r"%|_|\[\^?[^\]]+\]")


def literal_runs(text: str) -> list[str]:
    """Characters that a LIKE pattern needs next to each other, wildcards and sets taken out."""
    return [run for run in _PLACEHOLDER.split(text) if run]


def grams_of(text: Column) -> Column:
    """Distinct grams of a text in lower case; an empty array for a short or NULL one."""
    low = F.lower(text)
    last = F.length(low) - (GRAM - 1)
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, GRAM))
    return F.when(last >= 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _block(id_col: str) -> Column:
    return F.expr(f"`{id_col}` div {BLOCK} - if(`{id_col}` % {BLOCK} < 0, 1, 0)").cast("bigint")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows that follow each other and share their first column, the block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for start, end in zip(edge[:-1], edge[1:], strict=True):
            if held and (held[0].column(0)[0] != b.column(0)[start] or sum(h.num_rows for h in held) + end - start > CHUNK_ROWS
                         or sum(h.nbytes for h in held) > CHUNK_BYTES):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if end > start:
                held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and how many each has; NULL counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[offset[0]:offset[-1]] if texts.buffers()[2] is not None else b""
    try:
        joined = data.decode()
        begins = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))
        length = np.diff(begins[offset - offset[0]])
    except UnicodeDecodeError:
        each = [t.decode(errors="replace") for t in texts.to_pylist()]
        joined, length = "".join(each), np.array([len(t) for t in each])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64), length


def _lists(texts: pa.Array, place: np.ndarray) -> tuple[list[str], pa.Array]:
    """The distinct grams of texts in lower case, and the places of the texts that hold each."""
    code, length = _code_points(texts)
    count = np.maximum(length - (GRAM - 1), 0)
    row = np.repeat(np.arange(len(length)), count)
    first = np.arange(len(row)) + np.repeat((np.cumsum(length) - length) - (np.cumsum(count) - count), count)
    # Three code points of 21 bits.
    gram = code[first] << 42 | code[first + 1] << 21 | code[first + 2]
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.append(True, (np.diff(gram) != 0) | (np.diff(row) != 0))[:len(gram)]
    gram, row = gram[new], row[new]
    begin = np.flatnonzero(np.append(True, np.diff(gram) != 0)[:len(gram)])
    name = np.stack([gram[begin] >> 42, gram[begin] >> 21, gram[begin]], axis=1) & 0x1FFFFF
    names = name.astype(np.uint32).tobytes().decode("utf-32-le")
    return ([names[i:i + GRAM] for i in range(0, len(names), GRAM)],
            pa.ListArray.from_arrays(pa.array(np.append(begin, len(gram)), pa.int32()), pa.array(place[row], pa.int32())))


def _post(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            t = t.sort_by("place")
            place = t.column("place").to_numpy()
            for i, column in enumerate(columns):
                grams, ids = _lists(t.column(2 + i).combine_chunks(), place)
                yield pa.RecordBatch.from_arrays([pa.array([column] * len(grams), pa.string()), pa.array(grams, pa.string()),
                                                  pa.array(np.full(len(grams), t.column(0)[0].as_py())), ids], names=["column", "gram", "block", "ids"])
    return run


def write_search_index(rows: DataFrame, path: str, columns: list[str], id_col: str = "id") -> None:
    """Write ``rows`` and the postings of their search ``columns`` under ``path``.

    Rows with a NULL id cannot be named by a posting and are refused.
    """
    if not rows.where(F.col(id_col).isNull()).isEmpty():
        raise ValueError(f"{id_col} must not be NULL")
    write_folders(rows.withColumn("block", _block(id_col)).repartition("block"), f"{path}/rows", "block")
    # A block's rows are in one folder, so they follow each other: as a rule one array for each column, gram and block.
    texts = read_folders(rows.sparkSession, f"{path}/rows").select(
        "block", F.expr(f"pmod(`{id_col}`, {BLOCK})").cast("int").alias("place"), *[F.lower(F.col(c).cast("string")).alias(f"text{i}") for i, c in enumerate(columns)])
    lists = texts.mapInArrow(_post(columns), "column string, gram string, block bigint, ids array<int>").withColumn("bucket", _bucket(F.col("gram")))
    dealt = lists.repartition("bucket", F.pmod(F.floor(F.col("block") / SPREAD), F.lit(WRITERS)))
    write_folders(dealt.sortWithinPartitions("bucket", "gram", "column", "block"), f"{path}/postings", "bucket")


def candidates(spark: SparkSession, path: str, text: str, columns: list[str]) -> DataFrame | None:
    """(block, id) of rows with a column that holds all grams of the pattern; None if it has no gram."""
    runs = [r for r in literal_runs(text) if len(r) >= GRAM]
    if not runs:
        return None
    # The grams of the pattern by the same functions as those of the texts: a handful of constants.
    needed = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[grams_of(F.lit(r)) for r in runs]))).alias("g")).select(
        "g", F.transform("g", _bucket).alias("b")).first()
    held = read_folders(spark, f"{path}/postings").where(F.col("bucket").isin(sorted(set(needed.b))) & F.col("gram").isin(list(needed.g)) & F.col("column").isin(columns))
    # The arrays of the needed grams in one block meet in a group.
    both = held.groupBy("column", "block").agg(F.collect_list(F.struct("gram", "ids")).alias("lists"), F.count_distinct("gram").alias("n")).where(F.col("n") == len(needed.g))
    of = lambda gram: F.flatten(F.transform(F.filter("lists", lambda x: x["gram"] == gram), lambda x: x["ids"]))
    places = F.array_distinct(reduce(F.array_intersect, [of(F.lit(g)) for g in needed.g]))
    return both.select("block", F.explode(places).alias("place")).select("block", (F.col("block") * BLOCK + F.col("place")).alias("id")).distinct()


def search_stored(spark: SparkSession, path: str, text: str, columns: list[str], id_col: str = "id", null_safe: bool = True) -> DataFrame:
    """Rows of the stored table whose ``columns`` contain ``text``, as the plain search finds them."""
    rows = read_folders(spark, f"{path}/rows")
    found = candidates(spark, path, text, columns)
    if found is not None:
        found = found.select(F.col("block").alias("__block"), F.col("id").alias("__id"))
        rows = rows.join(found, (F.col("block") == F.col("__block")) & (F.col(id_col) == F.col("__id")), "left_semi")
    return rows.where(search_predicate(text, columns, null_safe)).drop("block")


def search_any(spark: SparkSession, path: str, texts: list[str], columns: list[str], id_col: str = "id", null_safe: bool = True) -> DataFrame:
    """Rows that contain one of ``texts``, each once."""
    parts = [search_stored(spark, path, t, columns, id_col, null_safe) for t in texts]
    return reduce(DataFrame.union, parts).dropDuplicates([id_col])
