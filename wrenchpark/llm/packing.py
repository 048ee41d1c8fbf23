"""Operator 2: packing by lexical retrieval.

Texts become token sequences, each ended by id 0, and are cut into windows of
``WINDOW`` tokens.  Full windows are sequences as they are; the tails are packed
so that a sequence holds texts with words in common.

1. Tasks encode the texts.  They keep a CRC for each full window and the ids of
   the tail.
2. Document frequencies of all tokens over all tails (a row for each token of
   the vocabulary at most) give BM25 its weights.
3. Rows are dealt into shards of bounded size by hash.  A shard builds an
   inverted BM25 index of its tails.  Each seed, the first unused tail, asks it
   with its heaviest tokens; the best unused neighbours that fit fill the
   window, and the best one that does not fit is cut to end it.  What is left
   of a cut tail stays unused.

So only the last sequence of a shard may be shorter than the window; it is split
into a power of two and a rest, which alone is padded.

Cases: a null text counts as empty; an empty one is the single id 0; null and
repeated ids are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import arrow_batches, slices, stage, table
from .groups import complete_groups

WINDOW = 1024
END = 0
ROWS_PER_SHARD = 1500
QUERY_TOKENS = 8
NEIGHBOURS = 32
K1, B = 1.2, 0.75
# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character the Unicode classes of both libraries agree; texts with runs of over LONG_RUN characters are slow in one of them.
FIRST_DOUBT, LONG_RUN = "԰", 500


class Encoder:
    """Token ids of a byte-level BPE tokenizer file.

    The file's own library is exact for every text.  Where both give the same
    ids, the vocabulary as ranks in the other library is four times as fast.
    """

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_str(spec)
        self.exact.no_truncation()
        self.exact.no_padding()
        raw = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        vocab, back = raw["model"]["vocab"], {c: b for b, c in enumerate(byte_characters())}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in raw["model"]["merges"]]
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        # Ranks stand for merge order only if ids follow it.
        ordered = all(a < b for a, b in zip(made, made[1:], strict=False)) and len(ranks) == 256 + len(made)
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def __call__(self, text: str) -> np.ndarray:
        easy = self.fast is not None and (text.isascii() or max(text) < FIRST_DOUBT) and not any(s in text for s in self.special)
        if easy and (len(text) <= LONG_RUN or max(map(len, text.split()), default=0) <= LONG_RUN) and "\x1c" not in text:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in slices(batches, "text"):
            encode = encode or Encoder(sent.value)
            total, tails, crcs = [], [], []
            for t in b.column(1).to_pylist():
                ids = np.append(encode(t or ""), np.uint32(END)).astype(np.uint32)
                full = len(ids) // WINDOW
                total.append(len(ids))
                crcs.append([crc(w) for w in ids[:full * WINDOW].reshape(full, WINDOW)])
                tails.append(ids[full * WINDOW:].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                                             names=["doc_id", "total", "crcs", "tail"])
    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n): in how many tails of the partition each token is."""
    count = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            ids = np.unique(np.frombuffer(raw, "<u4"))
            if len(ids) and ids[-1] >= len(count):
                count = np.append(count, np.zeros(int(ids[-1]) + 1 - len(count), np.int64))
            count[ids] += 1
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["token", "n"])


def pack_tails(tails: list[np.ndarray], idf: np.ndarray, mean: float) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (tail, start in it, length), every one but the last WINDOW long."""
    n = len(tails)
    size = np.array([len(t) for t in tails], np.int64)
    doc = np.repeat(np.arange(n), size)
    token = np.concatenate(tails).astype(np.int64) if n else np.zeros(0, np.int64)
    cell, tf = np.unique(token * n + doc, return_counts=True)
    token, doc = cell // max(n, 1), cell % max(n, 1)
    weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1e-9)))
    heads, first = np.unique(token, return_index=True)
    last = np.append(first[1:], len(token))
    # The tokens that a tail asks with: its heaviest ones.
    order = np.lexsort((-weight, doc))
    begin = np.searchsorted(doc[order], np.arange(n))
    left, start = size.copy(), np.zeros(n, np.int64)
    unused = left > 0
    at = 0
    while True:
        while at < n and not unused[at]:
            at += 1
        if at == n:
            return
        seed, room, out = at, WINDOW, []

        def take(i: int, length: int) -> None:
            out.append((i, int(start[i]), length))
            start[i] += length
            left[i] -= length
            unused[i] = left[i] > 0

        room -= int(left[seed])
        asked = np.searchsorted(heads, token[order[begin[seed]:begin[seed] + QUERY_TOKENS][doc[order[begin[seed]:begin[seed] + QUERY_TOKENS]] == seed]])
        take(seed, int(left[seed]))
        if room:
            lists = [slice(first[h], last[h]) for h in asked]
            score = np.bincount(np.concatenate([doc[x] for x in lists]), np.concatenate([weight[x] for x in lists]), n)
            score[~unused] = 0
            near = np.argsort(-score, kind="stable")[:NEIGHBOURS]
            near = near[score[near] > 0]
            for i in near.tolist():
                if left[i] <= room:
                    room -= int(left[i])
                    take(i, int(left[i]))
            best = [i for i in near.tolist() if unused[i]]
            # No neighbour left: the next unused rows, whatever their words.
            while room:
                i = best.pop(0) if best else int(unused[at:].argmax()) + at
                if not unused[i]:
                    break
                length = min(room, int(left[i]))
                room -= length
                take(i, length)
        yield out


def _pack(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = sent.value
        for t in complete_groups(batches, "shard"):
            shard = t.column("shard").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = t.slice(a, b - a).to_pydict()
                rows, number = [], int(shard[a]) << 32
                for d, (total, crcs) in enumerate(zip(part["total"], part["crcs"], strict=True)):
                    for k, c in enumerate(crcs):
                        rows.append((d, k * WINDOW, WINDOW, c, total, number, 0))
                        number += 1
                tails = [np.frombuffer(x, "<u4") for x in part["tail"]]
                for pieces in pack_tails(tails, idf, mean):
                    held = sum(p[2] for p in pieces)
                    # A short sequence is cut at the largest power of two in it.
                    cut = WINDOW if held == WINDOW else 1 << (held.bit_length() - 1)
                    offset = 0
                    for d, s, length in pieces:
                        while length:
                            if offset == cut:
                                number, offset, cut = number + 1, 0, WINDOW
                            step = min(length, cut - offset)
                            base = len(part["crcs"][d]) * WINDOW
                            rows.append((d, base + s, step, crc(tails[d][s:s + step]), part["total"][d], number, offset))
                            s, length, offset = s + step, length - step, offset + step
                    number += 1
                doc, *rest = zip(*rows, strict=True)
                ids = t.column("doc_id").slice(a, b - a).combine_chunks().take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in rest)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = stage(rows.mapInArrow(_encode(spec), f"doc_id {kind}, total long, crcs array<long>, tail binary")
                  .withColumn("row", F.monotonically_increasing_id()), "pack-rows")
    n, tokens = coded.agg(F.count("*"), F.sum(F.octet_length("tail") / 4)).first()
    # One row for each token of the vocabulary at most.
    counts = coded.select("tail").mapInArrow(_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, df = counts.column("token").to_numpy(), counts.column("n").to_numpy()
    idf = np.zeros(int(token.max(initial=0)) + 1)
    idf[token] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((idf, float(tokens or 0) / max(n, 1)))
    shards = max(1, -(-n // ROWS_PER_SHARD))
    n_parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 16))
    dealt = coded.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return (dealt.repartition(n_parts, "shard").sortWithinPartitions("shard", "row").select("shard", "doc_id", "total", "crcs", "tail")
            .mapInArrow(_pack(sent), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def op2_bm25_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
