"""Operator 3: BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. Words of all texts are counted: in each slice of a task with numpy, then by
   a grouping.  The ``LEXICON`` most frequent become the lexicon.
2. The driver merges them exactly and compiles them, with their ids, into one
   minimal acyclic automaton with shared suffixes: one flat array that Spark
   ships as a file and every worker maps into memory.
3. Tasks normalise and split texts as the tokenizer file says.  Distinct words
   not met before in a task walk the automaton all at once; words that it does
   not hold are merged exactly, all words of one length at once.

The result does not depend on which words the lexicon holds.

Cases: a null text counts as empty, and an empty one has no tokens; strings of
special tokens in a text become these tokens; null and repeated ids are rows
like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .automaton import IntTable, Lexicon
from .common import arrow_batches, slices, table

#: Words in the lexicon, and how often a word must occur in a slice of 4 MB to be counted there.
LEXICON = 100_000
LEAST_IN_SLICE = 3
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 400_000
#: Words longer than this are merged one by one, with a heap.
MATRIX_WIDTH = 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """Vocabulary and merge rules of a BPE tokenizer file with word ends, and exact merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int64)
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(self.tokens) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = IntTable(keys, np.arange(len(keys)))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.rank.get(a * self.size + b)
        return np.where(r < 0, len(self.made), r)

    def merge_matrix(self, chars: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length, given as rows of bytes: each round does every word's first and lowest merge."""
        n, width = chars.shape
        ids = self.inner[chars]
        ids[:, -1] = self.last[chars[:, -1]]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        who = np.arange(n)
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        none = len(self.made)
        while len(who):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(who), np.int64)
            best = rank[np.arange(len(who)), at] if rank.shape[1] else np.full(len(who), none)
            over = best == none
            if over.any():
                for i, row in zip(who[over].tolist(), ids[over], strict=True):
                    out[i] = row
                ids, rank, who, at, best = ids[~over], rank[~over], who[~over], at[~over], best[~over]
                if not len(who):
                    break
            rows = np.arange(len(who))
            ids[rows, at] = self.made[best]
            keep = np.ones(ids.shape, bool)
            keep[rows, at + 1] = False
            ids = ids[keep].reshape(len(who), -1)
            # The pair's own rank goes; those with its neighbours are looked up again.
            keep = np.ones(rank.shape, bool)
            keep[rows, at] = False
            rank = rank[keep].reshape(len(who), -1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ids.shape[1] - 1)
                rank[rows[ok], side[ok]] = self.ranks(ids[rows[ok], side[ok]], ids[rows[ok], side[ok] + 1])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, with a heap of pairs."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = np.array(ids)
        first = self.ranks(start[:-1], start[1:])
        none = len(self.made)
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if pair not in memo:
                memo[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if memo[pair] < none:
                heapq.heappush(heap, (memo[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int64)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        for at, chars in by_length(words):
            if chars is None:
                out[at] = self.merge_long(words[at])
            else:
                for i, ids in zip(at.tolist(), self.merge_matrix(chars), strict=True):
                    out[i] = ids
        return out


def by_length(words: list[bytes]) -> Iterator[tuple]:
    """(places, byte matrix) of the words of each length, and (place, None) of each that is too long for one."""
    size = np.array([len(w) for w in words])
    for i in np.flatnonzero(size > MATRIX_WIDTH).tolist():
        yield i, None
    order = np.argsort(size, kind="stable")
    for n in np.unique(size[size <= MATRIX_WIDTH]).tolist():
        at = order[np.searchsorted(size[order], n):np.searchsorted(size[order], n, side="right")]
        yield at, np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(len(at), n)


def unicode_drift() -> dict[str, tuple[str, str]]:
    """For L and N: characters of the class for ``regex`` but not for the tokenizers library, and the reverse.

    Under "lower": characters whose lower case Python does not know, and those lower cases.

    Both libraries follow different Unicode versions.  Only characters on which
    ``regex`` and Python disagree can differ, so only those are looked at.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for kind in ("L", "N"):
        ours = set(regex.findall(rf"\p{{{kind}}}", every))
        doubt = [c for c in every if (c in ours) != (unicodedata.category(c)[0] == kind)]
        split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True)
        theirs = {c for c, _ in split.pre_tokenize_str(" ".join(doubt))} if doubt else set()
        out[kind] = "".join(c for c in doubt if c in ours and c not in theirs), "".join(c for c in doubt if c in theirs and c not in ours)
    unknown = [c for c in every if unicodedata.category(c) == "Cn"]
    low = normalizers.Lowercase().normalize_str("".join(unknown))
    pairs = [(a, b) for a, b in zip(unknown, low, strict=True) if a != b]
    out["lower"] = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return out


def exact_pattern(pattern: str, drift: dict[str, tuple[str, str]]) -> str:
    """``pattern`` with the classes as the tokenizers library has them."""
    for kind in ("L", "N"):
        less, more = drift[kind]
        own = rf"\p{{{kind}}}"
        if less:
            own = f"[{own}--[{regex.escape(less)}]]"
        if more:
            own = f"[{own}||[{regex.escape(more)}]]"
        pattern = pattern.replace(rf"\p{{{kind}}}", own)
    return f"(?V1){pattern}"


class Splitter:
    """Texts to words and special tokens, as the tokenizer file's normaliser and pattern do."""

    def __init__(self, pattern: str, special: dict[str, int], drift: dict[str, tuple[str, str]]):
        self.words = regex.compile(pattern).findall
        self.exact_words = regex.compile(exact_pattern(pattern, drift)).findall
        self.lower = str.maketrans(*drift["lower"])
        self.first_odd = min("".join("".join(x) for x in drift.values()), default="\U0010ffff")
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.marks = {s[:2] for s in special}

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower case of each character on its own: no final form of sigma.
            text = text.replace("Σ", "σ")
            if max(text) >= self.first_odd:
                return self.exact_words(text.lower().translate(self.lower))
        return self.words(text.lower())

    def __call__(self, text: str) -> list[str]:
        """Words; special tokens are marked by a leading line feed, which no word has."""
        if not any(m in text for m in self.marks):
            return self.plain(text)
        return [w for p in self.cut(text) if p for w in (["\n" + p] if p in self.special else self.plain(p))]


class Encoder:
    """Words to ids with a memory of one task: word -> (ids, tokens, count), the first two as text."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.memory: dict[str, tuple[str, str, int]] = {}
        self.names = {i: str(i) for i in merges.tokens}

    def _keep(self, word: str, ids: list[int]) -> None:
        self.memory[word] = (" ".join([self.names[i] for i in ids]), " ".join([self.merges.tokens[i] for i in ids]), len(ids))

    def learn(self, words: set[str]) -> None:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = [w for w in words if w not in self.memory]
        raw = []
        for w in new:
            if w[0] == "\n":
                self._keep(w, [self.merges.special[w[1:]]])
                raw.append(b"")
            else:
                raw.append(w.encode())
        left = []
        for at, chars in by_length(raw):
            if chars is None:
                left.append(at)
            elif chars.shape[1]:
                rank = self.lexicon.ranks(chars) if self.lexicon else np.full(len(at), -1)
                left += at[rank < 0].tolist()
                held = rank >= 0
                for i, a, b in zip(at[held].tolist(), self.lexicon.starts[rank[held]] if self.lexicon else (), self.lexicon.starts[rank[held] + 1] if self.lexicon else (), strict=True):
                    self._keep(new[i], self.lexicon.ids[a:b].tolist())
        for i, ids in zip(left, self.merges.merge([raw[i] for i in left]), strict=True):
            self._keep(new[i], ids.tolist())

    def texts(self, texts: list[list[str]]) -> Iterator[tuple[str, str, int]]:
        """(ids, tokens, count) of each text, given as words."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        self.learn(set().union(*texts))
        for words in texts:
            found = [self.memory[w] for w in words]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of letter runs that are frequent in a slice."""
    for b in slices(batches, "text"):
        data, off = textnum.utf8(b.column(0))
        if not len(data):
            continue
        gaps = np.where(_LETTER[data], data, 32).astype(np.uint8)
        s, e, _ = textnum.words(textnum.LOWER[gaps], off)
        short = e - s <= MATRIX_WIDTH
        s, e = s[short], e[short]
        if not len(s):
            continue
        h = textnum.spans_hash(textnum.prefix(textnum.BYTE[textnum.LOWER[data]]), s, e)
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        first, n = first[n >= LEAST_IN_SLICE], n[n >= LEAST_IN_SLICE]
        words = [data[x:y].tobytes().decode("utf-8", "replace").lower() for x, y in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def frequent_words(texts: DataFrame, most: int = LEXICON) -> list[str]:
    """The most frequent words of all rows; ``most`` bounds what the driver gets."""
    counts = texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).toLocalIterator()]


def encode(docs: DataFrame, tokenizer: str, finish, schema: str, id_col: str = "doc_id", text_col: str = "text",
           lexicon_words: int = LEXICON) -> DataFrame:
    """Apply ``finish`` to (ids, tokens, count) of every text; its tuples follow the id in the result.

    ``ids`` are decimal and ``tokens`` the decoder's output, both joined by one space.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    merges = Merges(tokenizer)
    drift = unicode_drift()
    split = Splitter(merges.pattern, merges.special, drift)
    words = sorted({w for word in frequent_words(rows.select("text"), lexicon_words) for w in split.plain(word)})
    raw = [w.encode() for w in words]
    flat = Lexicon.build(dict(zip(raw, map(np.ndarray.tolist, merges.merge(raw)), strict=True))) if raw else None
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    if flat is not None:
        # On the driver only: Spark copies the file to every executor that runs a task.
        path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
        np.save(path, flat)
        spark.sparkContext.addFile(path)
    sent = spark.sparkContext.broadcast((merges, drift))
    has_lexicon = flat is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, drift = sent.value
        lexicon = Lexicon(np.load(SparkFiles.get(name), mmap_mode="r")) if has_lexicon else None
        encoder, split = Encoder(merges, lexicon), Splitter(merges.pattern, merges.special, drift)
        for b in slices(batches, "text"):
            made = [finish(*x) for x in encoder.texts([split(t) for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*made, strict=True))], names=["doc_id", *fields])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, f"doc_id {kind}, {schema}")


def _digests(ids: str, tokens: str, n: int) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()


def op3_transducer_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Ids and decoded text of every row of ``documents``, as digests."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encode(table(spark, sf_dir, "documents"), tokenizer, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
