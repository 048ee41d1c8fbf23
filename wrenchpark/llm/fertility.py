"""Operator 11: quality rules by tokeniser fertility.

Public vocabularies cut natural text of a language into tokens of a typical
length and variety; markup, encodings gone wrong, random strings and lists of
symbols are cut differently.

1. One pass over the texts gives each row plain counts (words, characters in
   them, symbols, repeated lines, words in repeated 8-word windows) and, for
   each vocabulary, three measures over the words, each encoded on its own:
   characters per token, the share of tokens that stand for single bytes of a
   character (byte fallback), and the entropy of the tokens in bits.
2. A band is kept for each language (the script of most letters where no
   language is given), length class (the binary logarithm of the number of
   tokens) and measure: the median plus or minus ``WIDTH`` robust deviations.
   Rounded measures are counted over all rows that pass the plain rules, each
   distinct set of measures once, so that many copies of one text do not make a band;
   medians come from these counts, whose number is bounded by the rounding.
   No deviation is taken below the measure's ``LEAST_SPREAD`` divided by the
   square root of the number of tokens, the noise of clean texts.
3. A class with fewer than ``LEAST_ROWS`` rows takes its language's band, a
   language with fewer takes fixed outer bounds (``OUTER``).
4. A row is kept if it passes the plain rules and every measure lies in its band.

Cases: a null or empty text, or one of white space, has no words and fails the
plain rules; null and repeated ids are rows like others; a null or empty language
counts as not given; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import arrow_batches, slices, stage, table

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
WIDTH = 5.0
LEAST_ROWS = 50
#: Rounding of the measures in the counts.
STEP = 1 / 512
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 800_000
#: Bands up to this number are broadcast (a row has a few dozen bytes); more are joined by a shuffle.
BROADCAST_BANDS = 20_000
MEASURES = ("chars_per_token", "byte_share", "entropy")
LEAST_SPREAD = {"chars_per_token": 0.8, "byte_share": 0.5, "entropy": 2.0}
OUTER = {"chars_per_token": (0.25, 16.0), "byte_share": (0.0, 0.5), "entropy": (1.0, 17.0)}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, np.int64)
_LEAD[128:192] = 0
# Scripts by the first byte of a character in UTF-8, as ranges; other bytes say nothing.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_SCRIPT = np.zeros(256, np.int64)
for _from, _to, _name in ((65, 90, "latin"), (97, 122, "latin"), (0xC3, 0xCA, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD6, 0xD7, "hebrew"),
                          (0xD8, 0xDB, "arabic"), (0xDC, 0xDF, "other"), (0xE0, 0xE0, "indic"), (0xE1, 0xE1, "other"), (0xE3, 0xE3, "kana"),
                          (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul"), (0xF0, 0xF4, "other")):
    _SCRIPT[_from:_to + 1] = SCRIPTS.index(_name)


class Vocabulary:
    """Words to token ids by a public vocabulary: a piece model, or byte ranks, by the file's ending."""

    def __init__(self, name: str, raw: bytes):
        if name.endswith(".tiktoken"):
            import base64

            import tiktoken
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            self.size = max(ranks.values()) + 1
            # The whole word is one piece: only merges cut it.
            own = tiktoken.Encoding("file", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [own.encode_ordinary(" " + w) for w in words]
            self.single = np.zeros(self.size, bool)
            self.single[[i for t, i in ranks.items() if len(t) == 1 and t[0] >= 128]] = True
        else:
            import sentencepiece
            own = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.size = own.vocab_size()
            self.encode = lambda words: own.encode(words, num_threads=1)
            self.single = np.array([own.is_byte(i) for i in range(self.size)])


class Words:
    """Tokens of distinct words, known by their hashes, for one task."""

    def __init__(self, vocabularies: list[Vocabulary]):
        self.vocabularies = vocabularies
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.starts = [np.zeros(1, np.int64) for _ in self.vocabularies]
        self.tokens = [np.zeros(0, np.int64) for _ in self.vocabularies]

    def places(self, hashes: np.ndarray, word) -> np.ndarray:
        """Place of each distinct hash; ``word(i)`` is the text of the i-th."""
        if len(self.place) > REMEMBERED:
            self._clear()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.place]
        if new:
            texts = [word(i) for i in new]
            for at, v in enumerate(self.vocabularies):
                made = v.encode(texts)
                size = np.fromiter(map(len, made), np.int64, len(made))
                self.starts[at] = np.concatenate([self.starts[at], self.starts[at][-1] + np.cumsum(size)])
                self.tokens[at] = np.concatenate([self.tokens[at], np.fromiter((t for m in made for t in m), np.int64, int(size.sum()))])
            self.place |= zip([keys[i] for i in new], range(len(self.place), len(self.place) + len(new)), strict=True)
        return np.fromiter((self.place[h] for h in keys), np.int64, len(keys))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of all pieces one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit value for a (document, hash) pair."""
    return textnum.mix(h + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def plain_counts(data: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, d: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the plain rules; words are given by start, end, document and hash."""
    n = len(off) - 1
    count = np.bincount(d, minlength=n)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    lead, symbol = sums(_LEAD[data]), sums(_SYMBOL[data])
    chars = np.bincount(d, lead[e] - lead[s], n).astype(np.int64)
    # Lines with a word, by the hash of their bytes.
    feed = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1], feed + 1]))
    begin = begin[begin < len(data)]
    doc = np.searchsorted(off, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), off[doc + 1])
    has_feed = (end > begin) & (data[end - 1] == 10) if len(begin) else np.zeros(0, bool)
    end = end - has_feed
    held = np.searchsorted(s, end) > np.searchsorted(s, begin)
    lines = _keyed(doc[held], textnum.spans_hash(textnum.prefix(textnum.BYTE[data]), begin[held], end[held]))
    _, first = np.unique(lines, return_index=True)
    same = np.bincount(doc[held], minlength=n) - np.bincount(doc[held][first], minlength=n)
    # Words in windows that occur again.
    rank = np.arange(len(s)) - (np.cumsum(count) - count)[d]
    at = np.flatnonzero(rank + WINDOW <= count[d])
    w = _keyed(d[at], textnum.spans_hash(textnum.prefix(h), at, at + WINDOW))
    order = np.argsort(w)
    equal = np.zeros(len(w), bool)
    next_same = w[order][1:] == w[order][:-1]
    equal[order[1:][next_same]] = True
    equal[order[:-1][next_same]] = True
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, at[equal], 1)
    np.add.at(cover, at[equal] + WINDOW, -1)
    repeated = np.bincount(d, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)
    return {"n_words": count, "word_chars": chars, "n_symbols": symbol[off[1:]] - symbol[off[:-1]], "n_dup_lines": same, "n_repeat_words": repeated}


def measures(words: Words, data: np.ndarray, n: int, s: np.ndarray, e: np.ndarray, d: np.ndarray, h: np.ndarray, chars: np.ndarray) -> list[dict[str, np.ndarray]]:
    """For each vocabulary the number of tokens and the measures of every text."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    place = words.places(h[first], lambda i: data[s[first[i]]:e[first[i]]].tobytes().decode("utf-8", "replace"))[which] if len(s) else np.zeros(0, np.int64)
    out = []
    for v, starts, tokens in zip(words.vocabularies, words.starts, words.tokens, strict=True):
        size = np.diff(starts)[place] if len(place) else place
        total = np.bincount(d, size, n)
        doc, ids = np.repeat(d, size), tokens[ragged(starts[place], size)]
        single = np.bincount(doc, v.single[ids], n)
        key = np.sort(doc * v.size + ids)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        times = np.diff(edge)
        spent = np.bincount(key[edge[:-1]] // v.size, times * np.log2(np.maximum(times, 1)), n) if len(times) else np.zeros(n)
        some = np.maximum(total, 1)
        out.append({"tokens": total.astype(np.int64), "chars_per_token": chars / some, "byte_share": single / some,
                    "entropy": np.maximum(np.log2(some) - spent / some, 0)})
    return out


def _fields(vocabularies: int) -> list[str]:
    return [f"{m}_{i}" for i in range(vocabularies) for m in ("tokens", *MEASURES)]


def measured(docs: DataFrame, vocabularies: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, lang, plain counts, measures) of every row.

    ``vocabularies`` are files on the driver; tasks get their contents.  A
    measure's name ends in the number of its vocabulary.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    files = []
    for path in vocabularies:
        with open(path, "rb") as f:
            files.append((path, f.read()))
    sent = spark.sparkContext.broadcast(files)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kinds = {c: "long" for c in counts} | {c: "long" if c.startswith("tokens") else "double" for c in _fields(len(files))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for b in slices(batches, "text"):
            words = words or Words([Vocabulary(*x) for x in sent.value])
            data, off = textnum.utf8(b.column(2))
            s, e, d = textnum.words(data, off)
            h = textnum.spans_hash(textnum.prefix(textnum.BYTE[data]), s, e)
            got = plain_counts(data, off, s, e, d, h)
            for i, m in enumerate(measures(words, data, len(off) - 1, s, e, d, h, got["word_chars"])):
                got |= {f"{k}_{i}": v for k, v in m.items()}
            hist = np.bincount((np.repeat(np.arange(len(off) - 1), np.diff(off)) * 16 + _SCRIPT[data]), minlength=(len(off) - 1) * 16).reshape(-1, 16)
            hist[:, 0] = 0
            lang = [x or SCRIPTS[y] for x, y in zip(b.column(1).to_pylist(), hist.argmax(axis=1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), *(pa.array(got[c], pa.int64() if k == "long" else pa.float64()) for c, k in kinds.items())],
                                             names=["doc_id", "lang", *kinds])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang string, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _class(tokens: Column) -> Column:
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)).cast("double"))).cast("int")


def bands(stats: DataFrame, vocabularies: int) -> DataFrame:
    """(measure, lang, class, rows, middle, spread); class -1 is the whole language."""
    names = [f"{m}_{i}" for i in range(vocabularies) for m in MEASURES]
    once = stats.where(~base_failed()).select("lang", *_fields(vocabularies)).distinct()
    long = once.select("lang", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), _class(F.col(f"tokens_{c.rsplit('_', 1)[1]}")).alias("class"), F.round(F.col(c) / STEP).cast("long").alias("value"))
        for c in names])).alias("x")).select("lang", "x.*")
    counts = long.groupBy("measure", "lang", "class", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("class", F.explode(F.array("class", F.lit(-1)))).groupBy("measure", "lang", "class", "value").agg(F.sum("n").alias("n"))
    key = ["measure", "lang", "class"]
    middle = counts.groupBy(*key).agg(F.sum("n").alias("rows"), F.percentile("value", F.lit(0.5), F.col("n")).alias("middle"))
    away = counts.join(middle, key).groupBy(*key).agg(
        F.first("rows").alias("rows"), F.first("middle").alias("middle"),
        F.percentile(F.abs(F.col("value") - F.col("middle")), F.lit(0.5), F.col("n")).alias("spread"))
    return away.where(F.col("rows") >= LEAST_ROWS).select(*key, "rows", (F.col("middle") * STEP).alias("middle"), (1.4826 * F.col("spread") * STEP).alias("spread"))


def judged(stats: DataFrame, vocabularies: int, width: float = WIDTH) -> DataFrame:
    """``stats`` with ``base_failed``, ``outside`` (measures outside their bands) and ``kept``."""
    found = stage(bands(stats, vocabularies), "fertility-bands")
    whole = lambda of: F.map_from_entries(F.collect_list(F.struct("measure", F.struct("middle", "spread")))).alias(of)
    by_lang = found.where("class < 0").groupBy(F.col("lang").alias("_lang")).agg(whole("_wide"))
    # One row for each language and class of each vocabulary, of at most three measures.
    by_class = found.where("class >= 0").groupBy(F.col("lang").alias("_lang"), F.col("class").alias("_class"), F.substring_index("measure", "_", -1).alias("_of")).agg(whole("_near"))
    small = found.count() <= BROADCAST_BANDS
    hint = F.broadcast if small else (lambda x: x)
    out = stats.join(hint(by_lang), F.col("lang") == F.col("_lang"), "left").drop("_lang")
    outside = []
    for i in range(vocabularies):
        own = by_class.where(F.col("_of") == str(i)).select("_lang", "_class", F.col("_near").alias(f"_near_{i}"))
        out = out.join(hint(own), (F.col("lang") == F.col("_lang")) & (_class(F.col(f"tokens_{i}")) == F.col("_class")), "left").drop("_lang", "_class")
        noise = F.sqrt(F.greatest(F.col(f"tokens_{i}"), F.lit(1)).cast("double"))
        for m in MEASURES:
            c = f"{m}_{i}"
            band = F.coalesce(F.try_element_at(f"_near_{i}", F.lit(c)), F.try_element_at("_wide", F.lit(c)))
            reach = width * F.greatest(band["spread"], F.lit(LEAST_SPREAD[m]) / noise)
            low, high = OUTER[m]
            least = F.lit(low) if m == "byte_share" else F.coalesce(band["middle"] - reach, F.lit(low))
            outside.append(F.when(~F.col(c).between(least, F.coalesce(band["middle"] + reach, F.lit(high))), F.lit(c)))
    out = out.withColumns({"base_failed": base_failed(), "outside": F.array_compact(F.array(*outside))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("_wide", *[f"_near_{i}" for i in range(vocabularies)])


def public_vocabularies() -> list[str]:
    import public_tokenizers
    return [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def quality_rules(docs: DataFrame, vocabularies: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str | None = "lang", width: float = WIDTH) -> DataFrame:
    """Counts, measures and verdict of every row of ``docs``."""
    files = public_vocabularies() if vocabularies is None else vocabularies
    return judged(stage(measured(docs, files, id_col, text_col, lang_col), "fertility"), len(files), width)


def op11_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    """Plain rules and fertility bands over all rows of ``documents``."""
    return quality_rules(table(spark, sf_dir, "documents"))
