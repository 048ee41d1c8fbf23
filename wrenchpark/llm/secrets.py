"""Operator 9: secret scan with character Markov models, in DataFrame functions only.

Fixed patterns find assignments of secrets, access keys and long hexadecimal
runs.  Two character Markov models add what has no fixed form: one of random
strings, trained on the values that the patterns found anywhere in the corpus,
and one of ordinary runs, trained on the short runs of the same characters
(words, numbers, short paths) outside these values, of all rows.
A long run of key characters is a secret if the mean log-likelihood ratio of
its transitions exceeds ``RATIO``.  Transitions from or to a separator and those
between digits have a ratio of 0: they show where paths, hyphenated words, lines
and numbers are joined, not whether their pieces are random.  So a run of digits
and separators alone is never random.

Both models are one table of 68 x 68 numbers, counted with a grouping.

Spans are in code points of the text, end exclusive.  Cases: a null or empty
text has no spans; null and repeated ids are rows like others; without training
rows both models are uniform and add nothing; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# The patterns of the base spans and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of the Markov models; code 0 stands for all others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SEPARATORS, DIGITS = "+/_=-", "0123456789"
#: Runs that train the ordinary model: shorter than a candidate, so that no candidate speaks for itself.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,19}+(?![A-Za-z0-9+/_=-])"
#: What base spans hold does not train it.
BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|""" + ACCESS + "|" + HEX
#: Mean log-likelihood ratio of a transition from which a run counts as random.
RATIO = 0.5
BACK_OFF = 5.0
MASK = "[SECRET]"
#: Matches whose places are found one after the other.
RUN = 256

_SPANS = "array<struct<s:int,e:int,v:string>>"


def _runs(array: Column) -> Column:
    """``array`` cut into arrays of ``RUN`` elements.  It must be a lambda's argument, for it is named more than once."""
    last = F.greatest(F.ceil(F.size(array) / RUN).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(array, i * RUN + 1, F.lit(RUN)))


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end and ``group`` of all matches, from left to right: the pieces between the matches give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(found.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("p"))
    # The last piece follows the last match.
    parts = F.slice(parts, 1, F.size(parts) - 1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("out"))

    # An array that grows is copied at each match, so it grows within runs of RUN matches only; whole runs are then moved to their places.
    # The parts are made once a text: a lambda's argument is a value, while an expression in a lambda is computed each time.
    runs = F.flatten(F.transform(F.array(parts), lambda p: F.transform(_runs(p), lambda run: F.aggregate(run, empty, step))))
    moved = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))

    def move(acc, run):
        there = F.transform(run["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["v"].alias("v")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(there)).alias("out"))

    spans = F.aggregate(runs, moved, move, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(places(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= ASSIGN_VALUE)
    return {"assign": assign, "access": places(text, ACCESS), "hex": places(text, HEX)}


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _transitions(tokens: DataFrame, label: int) -> DataFrame:
    """Counts (label, cell, n) of neighbouring characters of the column ``token``."""
    # Equal tokens are cut into transitions once.
    codes = tokens.groupBy("token").agg(F.count("*").alias("times")).select(_codes(F.col("token")).alias("c"), "times")
    cells = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * SIDE + b)
    return (codes.where("size(c) > 1").select(F.explode(cells).alias("cell"), "times")
            .groupBy("cell").agg(F.sum("times").alias("n")).select(F.lit(label).alias("label"), "cell", "n"))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each transition."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    secret = rows.select(F.explode(F.concat(*base_spans(F.col("text")).values())).alias("x")).select(F.col("x.v").alias("token"))
    plain = rows.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", BASE, " "), F.lit(ORDINARY), F.lit(0))).alias("token"))
    count = {0: {}, 1: {}}
    for r in _transitions(secret, 1).union(_transitions(plain, 0)).collect():
        count[r.label][r.cell] = r.n
    return ratios(count[1], count[0])


def ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """Logarithms of P(next | character) under the random model over that under the ordinary one.

    Random strings follow their counts or, one time in two, any alphabet with
    equal chances.  Ordinary runs back off to how frequent the next character is
    at all and take any character one time in 100, so that no single transition
    decides for a run.  Separators and pairs of digits say nothing.
    """
    apart = {ALPHABET.index(c) + 1 for c in SEPARATORS}
    digits = {ALPHABET.index(c) + 1 for c in DIGITS}
    total = sum(ordinary.values())
    share = [(sum(ordinary.get(a * SIDE + c, 0) for a in range(SIDE)) + 1) / (total + SIDE) for c in range(SIDE)]
    out = []
    for a in range(SIDE):
        row = range(a * SIDE, (a + 1) * SIDE)
        r, o = sum(random.get(c, 0) for c in row), sum(ordinary.get(c, 0) for c in row)
        for c, p in zip(row, share, strict=True):
            if apart & {a, c % SIDE} or digits >= {a, c % SIDE}:
                out.append(0.0)
                continue
            likely = 0.5 / SIDE + 0.5 * (random.get(c, 0) + 1) / (r + SIDE)
            plain = 0.01 / SIDE + 0.99 * (ordinary.get(c, 0) + BACK_OFF * p) / (o + BACK_OFF)
            out.append(math.log(likely) - math.log(plain))
    return out


def _random(text: Column, model: Column) -> Column:
    """Long runs of key characters that the models take for random."""
    def mean(x):
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(
            F.get(model, acc["last"] * SIDE + c))).alias("sum"))
        return F.aggregate(_codes(x["v"]), start, step, lambda acc: acc["sum"]) / (F.length(x["v"]) - 1)
    return F.filter(places(text, CANDIDATE), lambda x: mean(x) > RATIO)


def scan(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with array columns _assign, _access, _hex and _random of (s, e, v)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table_col = F.from_json(F.lit(json.dumps(model)), "array<double>")
    out = docs.withColumns({f"_{k}": c for k, c in base_spans(text).items()} | {"_random": _random(text, table_col)})
    base = F.concat("_assign", "_access", "_hex")
    apart = F.filter("_random", lambda x: ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    return out.withColumn("_random", apart)


def _joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as listed."""
    def tagged(i: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k")))

    every = [tagged(i, kind) for i, kind in enumerate(kinds)]
    ordered = F.array_sort(F.concat(*every))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with all found spans replaced by ``MASK``; spans that overlap are replaced as one."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    found = scan(rows, model, "_text")
    spans = F.array_sort(F.transform(F.concat("_assign", "_access", "_hex", "_random"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    nothing = F.array().cast("array<string>")

    def step(acc, x):
        before = F.when(x["s"] >= acc["at"], F.concat(F.substring("_text", acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(before)).alias("out"))

    def run_step(acc, run):
        done = F.aggregate(run, F.struct(acc["at"].alias("at"), nothing.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.array_join(x["out"], "").alias("out")))
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), F.lit(0))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    done = F.aggregate(F.flatten(F.transform(F.array("_spans"), _runs)), start, run_step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring("_text", acc["at"] + 1, F.length("_text"))))
    text = F.when(F.size("_spans") > 0, done).otherwise(F.col("_text"))
    return found.withColumn("_spans", spans).select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op9_markov_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(_joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
