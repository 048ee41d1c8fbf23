"""Operator 12: alignment of two tokenizers' tokens over the same bytes.

A text with one space before it is cut by a byte-level vocabulary (A) and by a
piece model (B).  Byte offsets where tokens of both end cut them into groups.
A token of A and one of B are linked where their byte ranges overlap; how many
documents hold a linked pair of ids is counted over the whole corpus.

1. Tasks encode their texts.  Galloping intersection: the ends of the side with
   fewer tokens drive the search.  Each gallops from its expected place in the
   other side's ends, by steps that double, and ends with a binary search; all
   ends of a batch search at once.  Common ends cut groups, and the difference
   of two neighbouring ranks is the range of overlapping tokens.
2. A task's texts form blocks of ``BLOCK_LINKS`` distinct links or somewhat more
   (a text is never split).  A block stages its texts with their links as
   places in the block's own table of pairs, and that table, once, with the
   number of its texts that hold each pair.  So what is shuffled for the counts
   is a row for each pair and block, not for each pair and text.
3. The tables of all blocks are summed to the corpus' counts and joined back.
   Blocks and their texts meet again, the table first, and each text sums up
   the counts of its links.

A piece model's control pieces never come from a text; offsets are those of the
bytes of space + text.

Cases: a text that is null or empty, or that either side does not give back byte
by byte (a U+2581 in the text, or bytes that a vocabulary lacks), has no tokens:
zeros and no groups; null and repeated ids are rows like others and count as
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .bpe import byte_characters
from .common import arrow_batches, slices, stage, table
from .fertility import ragged
from .packing import FIRST_DOUBT, LONG_RUN, Encoder

# Fixed value: white space beyond ASCII.
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct pieces of text that a task remembers before it starts anew.
REMEMBERED = 250_000
#: Distinct links of single texts after which a block ends.
BLOCK_LINKS = 1_500_000
#: Bytes of text that are aligned at once.
SLICE = 2 << 20


class Memory:
    """Ids of pieces of text that were met before in a task, known by their hashes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the pieces' borders among them."""
        if len(self.place) > REMEMBERED:
            self._clear()
        hashes, first, which = np.unique(textnum.spans_hash(pre, start, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.place]
        if new:
            at = first[new]
            made = self.encode([data[x:y].tobytes().decode() for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.int64, int(size.sum()))])
            self.place |= zip([keys[i] for i in new], range(len(self.place), len(self.place) + len(new)), strict=True)
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[which]
        size = np.diff(self.starts)[at]
        return self.ids[ragged(self.starts[at], size)], np.concatenate([[0], np.cumsum(size)])


class Side:
    """A vocabulary's ids of texts, and the bytes of each id."""

    def __init__(self, spelt: list[bytes]):
        self.size = len(spelt)
        self.length = np.array([len(b) for b in spelt], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.memory = Memory(self.pieces)

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text that begins with the added space."""
        raise NotImplementedError

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Marks of the bytes before which a text may be cut without changing its tokens."""
        raise NotImplementedError

    def same(self, ids: np.ndarray, first: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts the ids give back byte by byte."""
        size = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        ok = np.diff(ends) == np.diff(off)
        sure = np.repeat(ok, np.diff(first))
        made = self.flat[ragged(self.start[ids[sure]], size[sure])]
        wrong = np.concatenate([[0], np.cumsum(made != data[np.repeat(ok, np.diff(off))])])
        borders = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(off), 0))])
        return ok & (np.diff(wrong[borders]) == 0)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the texts' borders among them, and which texts they give back.

        Equal pieces are encoded once.  What their ids do not give back is encoded as a whole.
        """
        mark = self.cuts(data, off)
        mark[off[:-1]] = True
        start = np.flatnonzero(mark)
        ids, ends = self.memory(data, textnum.prefix(textnum.BYTE[data]), start, np.append(start[1:], len(data)))
        first = ends[np.searchsorted(start, off)]
        ok = self.same(ids, first, data, off)
        if not ok.all():
            parts = np.split(ids, first[1:-1])
            for i in np.flatnonzero(~ok).tolist():
                parts[i] = self.whole(data[off[i]:off[i + 1]].tobytes().decode())
            ids, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ok = self.same(ids, first, data, off)
        return ids, first, ok


class ByteSide(Side):
    """A byte-level tokenizer file.  Its pattern never joins a character with white space
    after it, so texts can be cut before each run of white space."""

    def __init__(self, spec: str):
        self.own = Encoder(spec)
        # Strings of special tokens in a text are plain text.
        self.own.exact.encode_special_tokens = True
        self.own.special = {}
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.own.exact.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            spelt[i] = bytes(back[c] for c in t) if all(c in back for c in t) else b""
        super().__init__(spelt)

    def whole(self, text: str) -> np.ndarray:
        return self.own(text).astype(np.int64)

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        space = textnum.SPACE[data]
        after = space.copy()
        # The last bytes of other white space: no cut between it and the space after it.
        before = np.concatenate([[0], data[:-1]])
        for at in np.flatnonzero((data >= 128) & np.isin(before, [c.encode()[-2] for c in WIDE_SPACES]) & np.isin(data, [c.encode()[-1] for c in WIDE_SPACES])):
            if data[max(at - 2, 0):at + 1].tobytes().decode("utf-8", "ignore")[-1:] in WIDE_SPACES:
                after[at] = True
        mark = space
        mark[1:] &= ~after[:-1]
        odd = np.concatenate([[0], np.cumsum((data >= 28) & (data <= 31))])
        return mark & np.repeat(np.diff(odd[off]) == 0, np.diff(off))

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """Short pieces, which begin with white space and end without, are encoded one after the other in one text."""
        easy = [self.own.fast is not None and len(p) <= LONG_RUN and max(p) < FIRST_DOUBT and p[0].isspace() and not p[-1].isspace() for p in pieces]
        joined = "".join([p for p, e in zip(pieces, easy, strict=True) if e])
        ids = self.own.fast.encode_ordinary(joined) if joined else []
        ends = np.cumsum(self.length[np.array(ids, np.int64)])
        stop = np.searchsorted(ends, np.cumsum([len(p.encode()) for p, e in zip(pieces, easy, strict=True) if e])) + 1
        parts = iter([ids[x:y] for x, y in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)] if joined else [])
        return [next(parts) if e else self.own(p).tolist() for p, e in zip(pieces, easy, strict=True)]


class PieceSide(Side):
    """A piece model, which itself adds the space.  Where none of its pieces has a space
    after another character, texts can be cut before each run of spaces."""

    def __init__(self, raw: bytes):
        import sentencepiece
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        plain = lambda i: not (self.own.is_control(i) or self.own.is_unknown(i) or self.own.is_unused(i))
        spelt = [bytes([int(self.own.id_to_piece(i)[3:5], 16)]) if self.own.is_byte(i)
                 else self.own.id_to_piece(i).replace("▁", " ").encode() if plain(i) else b"" for i in range(self.own.vocab_size())]
        self.apart = not any(b" " in b.lstrip(b" ") for b in spelt)
        super().__init__(spelt)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text[1:]), np.int64)

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        mark = (data == 32) & self.apart
        mark[1:] &= data[:-1] != 32
        return mark

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        return self.own.encode([p[1:] for p in pieces], num_threads=1)


def gallop(want: np.ndarray, into: np.ndarray, guess: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each of ``want`` the place of the first value of sorted ``into`` in [first, last) not below it, else ``last``.

    Searches start at ``guess`` and double their steps away from it until the
    place is enclosed, then halve the enclosed range.
    """
    low, high = first.copy(), last.copy()
    if not len(want):
        return low
    at = np.clip(guess, first, np.maximum(last - 1, first))
    inside = first < last
    below = np.zeros(len(want), bool)
    below[inside] = into[at[inside]] < want[inside]
    # low: all before it are below; high: at it, or the end, is one not below.
    low[below] = at[below] + 1
    up = inside & ~below
    high[up] = at[up]
    step = 1
    open_ = np.flatnonzero(inside)
    while len(open_):
        rising = below[open_]
        probe = np.where(rising, low[open_] + step - 1, high[open_] - step)
        reach = (probe < high[open_]) & (probe >= low[open_])
        open_, rising, probe = open_[reach], rising[reach], probe[reach]
        small = into[probe] < want[open_]
        low[open_[small]] = probe[small] + 1
        high[open_[~small]] = probe[~small]
        open_ = open_[small == rising]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        small = into[middle] < want[open_]
        low[open_[small]] = middle[small] + 1
        high[open_[~small]] = middle[~small]
        open_ = open_[low[open_] < high[open_]]
    return low


def intersect(short: np.ndarray, short_first: np.ndarray, long: np.ndarray, long_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, common) of each end in ``short`` among those of ``long``, document by document.

    ``*_first`` are the n+1 borders of the documents; ranks are positions in ``long``.
    """
    n = np.diff(short_first)
    doc = np.repeat(np.arange(len(n)), n)
    first, last = long_first[:-1][doc], long_first[1:][doc]
    within = np.arange(len(short)) - short_first[:-1][doc]
    guess = first + within * (last - first) // np.maximum(n[doc], 1)
    rank = gallop(short, long, guess, first, last)
    common = np.zeros(len(short), bool)
    held = rank < last
    common[held] = long[rank[held]] == short[held]
    return rank, common


def _only(ids: np.ndarray, first: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and borders of the texts, those not ``ok`` without ids."""
    size = np.diff(first)
    return ids[np.repeat(ok, size)], np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])


class Aligned:
    """Tokens of a batch of texts on both sides, with groups and links as flat arrays.

    ``a``, ``b`` are ids, ``a_first``, ``b_first`` the borders of the texts,
    ``a_end``, ``b_end`` the ends in bytes.  ``a_cut``, ``b_cut`` mark a group's last token.
    ``left``, ``right`` are the positions of linked tokens.
    """

    def __init__(self, texts: list[str], a_side: ByteSide, b_side: PieceSide):
        self.n = len(texts)
        spaced = pa.array([" " + t for t in texts], pa.large_string())
        data, off = textnum.utf8(spaced)
        a, a_first, a_ok = a_side.encode(data, off)
        b, b_first, b_ok = b_side.encode(data, off)
        ok = a_ok & b_ok & (np.diff(off) > 1)
        (self.a, self.a_first), (self.b, self.b_first) = _only(a, a_first, ok), _only(b, b_first, ok)
        # Ends rise through the whole batch: each text goes on where the one before it ends.
        self.a_end, self.b_end = np.cumsum(a_side.length[self.a]), np.cumsum(b_side.length[self.b])
        self._align()

    def _align(self) -> None:
        na, nb = np.diff(self.a_first), np.diff(self.b_first)
        self.a_cut, self.b_cut = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        left, right = [], []
        for a_drives in (True, False):
            use = na <= nb if a_drives else na > nb
            s_first, l_first = (self.a_first, self.b_first) if a_drives else (self.b_first, self.a_first)
            s_end, l_end = (self.a_end, self.b_end) if a_drives else (self.b_end, self.a_end)
            s_cut, l_cut = (self.a_cut, self.b_cut) if a_drives else (self.b_cut, self.a_cut)
            size = np.where(use, np.diff(s_first), 0)
            at = ragged(s_first[:-1], size)
            if not len(at):
                continue
            borders = np.concatenate([[0], np.cumsum(size)])
            spans = np.where(use, np.diff(l_first), 0)
            place = ragged(l_first[:-1], spans)
            rank, common = intersect(s_end[at], borders, l_end[place], np.concatenate([[0], np.cumsum(spans)]))
            s_cut[at], l_cut[place[rank[common]]] = common, True
            # A token overlaps from where the one before it ended up to its own rank.
            begin = np.empty(len(at), np.int64)
            begin[1:] = rank[:-1] + common[:-1]
            opens = borders[:-1][size > 0]
            begin[opens] = (np.cumsum(spans) - spans)[size > 0]
            many = rank - begin + 1
            s, o = np.repeat(at, many), place[ragged(begin, many)]
            left.append(s if a_drives else o)
            right.append(o if a_drives else s)
        self.left = np.concatenate([np.zeros(0, np.int64), *left])
        self.right = np.concatenate([np.zeros(0, np.int64), *right])
        self.doc = np.searchsorted(self.a_first, self.left, side="right") - 1
        self.n_groups = self._per_doc(self.a_cut, self.a_first)

    @staticmethod
    def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])

    def interleaved(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens in the order of their groups, A's before B's in each, as 4 * id + 2 * (B) + (last in its group); and the texts' borders."""
        ga = np.concatenate([[0], np.cumsum(self.a_cut)])
        gb = np.concatenate([[0], np.cumsum(self.b_cut)])
        # Tokens of A in the first g groups, and of B.
        upto_a = np.concatenate([[0], np.flatnonzero(self.a_cut) + 1])
        upto_b = np.concatenate([[0], np.flatnonzero(self.b_cut) + 1])
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + upto_b[ga[:-1]]] = 4 * self.a + self.a_cut
        out[np.arange(len(self.b)) + upto_a[gb[:-1] + 1]] = 4 * self.b + 2 + self.b_cut
        return out, self.a_first + self.b_first

    def groups(self, i: int) -> list[tuple[int, int, list[int], list[int]]]:
        """(first byte, end, ids of A, ids of B) of each group of the i-th text."""
        a, b = slice(*self.a_first[i:i + 2]), slice(*self.b_first[i:i + 2])
        ends = self.a_end[a][self.a_cut[a]]
        zero = self.a_end[a.start - 1] if a.start else 0
        begin = np.concatenate([[zero], ends[:-1]]) if len(ends) else ends
        parts = lambda ids, cut: [p.tolist() for p in np.split(ids, np.flatnonzero(cut)[:-1] + 1)]
        return list(zip((begin - zero).tolist(), (ends - zero).tolist(), parts(self.a[a], self.a_cut[a]), parts(self.b[b], self.b_cut[b]), strict=True)) if len(ends) else []


def group_digests(batch: Aligned, names: np.ndarray) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text, '' without tokens."""
    code, first = batch.interleaved()
    parts = names[code].tolist()
    return [hashlib.sha256("".join(parts[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def token_names(size: int) -> np.ndarray:
    """Text of each code of ``interleaved``: the decimal id and what separates it from the next."""
    return np.array([f"{i}{c}" for i in range(size) for c in (",", "|", ",", ";")], object)


class Block:
    """Texts of a task with their links, until there are enough of these."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.links = 0

    def add(self, row: pa.RecordBatch, batch: Aligned, b_size: int) -> None:
        code = batch.a[batch.left] * b_size + batch.b[batch.right]
        key = np.sort((batch.doc << 33) | code)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        self.rows.append(row)
        self.pairs.append(key[edge[:-1]] & ((1 << 33) - 1))
        self.times.append(np.diff(edge).astype(np.uint32))
        self.size.append(np.bincount(key[edge[:-1]] >> 33, minlength=batch.n))
        self.links += len(edge) - 1

    def tables(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The block's row of pairs, and its texts."""
        if not self.rows:
            return
        name = uuid.uuid4().hex
        pairs = np.concatenate(self.pairs)
        held, place = np.unique(pairs, return_inverse=True)
        count = np.bincount(place, minlength=len(held))
        # Frequent pairs first: their places are small numbers, which compress well.
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(held), np.uint32)
        rank[order] = np.arange(len(held), dtype=np.uint32)
        place = rank[place]
        blank = [pa.nulls(1, f.type) for f in schema]
        fill = dict(zip(schema.names, blank, strict=True)) | {"block": pa.array([name]), "pairs": one_list(held[order]), "docs": one_list(count[order])}
        yield pa.RecordBatch.from_arrays([fill[c] for c in schema.names], schema=schema)
        at = 0
        for row, size, times in zip(self.rows, self.size, self.times, strict=True):
            ends = np.cumsum(size)
            of = place[at:at + len(times)].astype("<u4")
            at += len(times)
            cut = lambda x, e=ends, s=size: pa.array([x[e_ - s_:e_].tobytes() for e_, s_ in zip(e.tolist(), s.tolist(), strict=True)], pa.binary())
            fill = dict(zip(row.schema.names, row.columns, strict=True)) | {
                "block": pa.array([name] * row.num_rows), "places": cut(of), "times": cut(np.minimum(times, 255).astype(np.uint8)),
                "more": cut_more(times, size), "pairs": pa.nulls(row.num_rows, pa.list_(pa.int64())), "docs": pa.nulls(row.num_rows, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([fill[c] for c in schema.names], schema=schema)


def one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def cut_more(times: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each text what its links' numbers hold above 255, in the order of the links that have 255 or more."""
    ends = np.cumsum(size)
    over = times >= 255
    if not over.any():
        return pa.array([b""] * len(size), pa.binary())
    return pa.array([(times[e - s:e][over[e - s:e]] - 255).astype("<u4").tobytes() for e, s in zip(ends.tolist(), size.tolist(), strict=True)], pa.binary())


def links_of(places: bytes, times: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers) of a staged text."""
    n = np.frombuffer(times, np.uint8).astype(np.int64)
    if more:
        n[n == 255] += np.frombuffer(more, "<u4")
    return np.frombuffer(places, "<u4"), n


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string()}[kind]


def staged_links(docs: DataFrame, byte_file: str, piece_file: str, finish: Callable[[Aligned], dict[str, list]], schema: str,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Step 1 and 2: rows of texts and of blocks, staged.  ``finish`` gives the columns of ``schema`` for a batch."""
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(byte_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        sent = spark.sparkContext.broadcast((f.read(), g.read()))
    own = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    extra = [c.split() for c in schema.split(", ")]
    ddl = (f"doc_id {own}, block string, n_a long, n_b long, n_groups long, n_links long, {schema}, "
           "places binary, times binary, more binary, pairs array<long>, docs array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, block, out = None, Block(), None
        for b in slices(batches, "text", SLICE):
            sides = sides or (ByteSide(sent.value[0]), PieceSide(sent.value[1]))
            batch = Aligned(b.column(1).to_pylist(), *sides)
            got = finish(batch)
            row = pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(batch.a_first), np.diff(batch.b_first), batch.n_groups, np.bincount(batch.doc, minlength=batch.n))),
                 *(pa.array(got[c], _arrow(k)) for c, k in extra)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", *(c for c, _ in extra)])
            out = out or pa.schema([("doc_id", b.column(0).type), ("block", pa.string()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                                    *((c, _arrow(k)) for c, k in extra), *((c, pa.binary()) for c in ("places", "times", "more")),
                                    *((c, pa.list_(pa.int64())) for c in ("pairs", "docs"))])
            block.add(row, batch, sides[1].size)
            if block.links >= BLOCK_LINKS:
                yield from block.tables(out)
                block = Block()
        if out is not None:
            yield from block.tables(out)

    return stage(rows.mapInArrow(run, ddl), "alignment")


def pair_counts(staged: DataFrame, b_size: int) -> DataFrame:
    """(pair, a_id, b_id, documents, best): in how many documents each pair of ids is linked, and whether no pair of its A id has more."""
    entries = staged.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = entries.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("documents"))
    counts = stage(counts.select("pair", F.floor(F.col("pair") / b_size).cast("long").alias("a_id"), (F.col("pair") % b_size).alias("b_id"), "documents"), "alignment-pairs")
    most = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "documents", (F.col("documents") == F.col("most")).alias("best"))


def with_counts(staged: DataFrame, b_size: int) -> DataFrame:
    """Step 3: every text with ``n_best`` and ``count_sum`` of its links."""
    entries = staged.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    known = entries.join(pair_counts(staged, b_size).select("pair", "documents", "best"), "pair")
    # The place and the mark of the best share one number: a block has fewer than 2^32 pairs.
    known = known.select("block", F.lit(0).alias("kind"), (F.col("place").cast("long") * 2 + F.col("best").cast("long")).alias("place_best"), "documents")
    texts = staged.where("pairs is null").drop("pairs", "docs")
    keep = [f for f in texts.schema if f.name not in ("block", "places", "times", "more")]
    blank = lambda df, other: df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in other.schema if f.name not in df.columns})
    both = blank(texts.withColumn("kind", F.lit(1)), known).unionByName(blank(known, texts))
    spread = both.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, count, best = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            column = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            blocks = column["block"].to_pylist()
            kinds = np.asarray(column["kind"])
            edge = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1] or kinds[i] != kinds[i - 1]), len(blocks)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if blocks[x] != now:
                    now, parts, count = blocks[x], [], None
                if kinds[x] == 0:
                    parts.append((np.asarray(column["place_best"].slice(x, y - x)), np.asarray(column["documents"].slice(x, y - x))))
                    continue
                if count is None:
                    place = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)])
                    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                    count[place >> 1] = np.concatenate([np.zeros(0, np.int64), *(d for _, d in parts)])
                    best[place >> 1] = place & 1
                    parts = []
                n_best, total = [], []
                for raw in zip(*(column[c].slice(x, y - x).to_pylist() for c in ("places", "times", "more")), strict=True):
                    place, times = links_of(*raw)
                    n_best.append(int((times * best[place]).sum()))
                    total.append(int((times * count[place]).sum()))
                yield pa.RecordBatch.from_arrays([*(column[f.name].slice(x, y - x) for f in keep), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                                                 names=[*(f.name for f in keep), "n_best", "count_sum"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return spread.mapInArrow(run, f"{ddl}, n_best long, count_sum long")


def align(docs: DataFrame, byte_file: str, piece_file: str, finish: Callable[[Aligned], dict[str, list]], schema: str,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum) and the columns of ``finish`` for every row.

    ``finish`` takes an ``Aligned`` batch, from which it may take the groups'
    bytes and ids, and returns lists for the columns named in ``schema``.
    """
    import sentencepiece
    size = sentencepiece.SentencePieceProcessor(model_file=piece_file).vocab_size()
    return with_counts(staged_links(docs, byte_file, piece_file, finish, schema, id_col, text_col), size)


_names: dict[str, np.ndarray] = {}


def _digests(batch: Aligned) -> dict[str, list]:
    # Made once in each worker.
    size = max(int(batch.a.max(initial=0)), int(batch.b.max(initial=0))) + 1
    if len(_names.get("of", ())) < 4 * size:
        _names["of"] = token_names(max(size, 1 << 16))
    return {"groups_sha256": group_digests(batch, _names["of"])}


def op12_token_alignment(spark, sf_dir: str, byte_file: str | None = None, piece_file: str | None = None) -> DataFrame:
    """Alignment of every row of ``documents``, its groups as a digest."""
    if byte_file is None or piece_file is None:
        import public_tokenizers
        byte_file, piece_file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), byte_file, piece_file, _digests, "groups_sha256 string")
