"""Hash tables and minimal acyclic automata as flat arrays, looked up for many keys at once."""

from __future__ import annotations

import numpy as np


class IntTable:
    """Map of non-negative 64-bit keys to values: open addressing, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[at[open_]] < 0
            # Of several keys that want one free slot the last one written gets it.
            self.keys[at[open_[free]]] = keys[open_[free]]
            placed = self.keys[at[open_]] == keys[open_]
            self.values[at[open_[placed]]] = values[open_[placed]]
            open_ = open_[~placed]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


def compile_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words.

    Returns edges as (state * 256 + byte, target, words before this edge) and a
    flag for accepting states; state 0 is the start.  The sum of "words before"
    along a word's path is its rank among the words, which names its output.
    """
    known: dict[tuple, int] = {}
    done: list[tuple[bool, tuple]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(done)
            done.append(key)
        return at

    # The path of the last word is still open: [accepting, [(byte, state), ...]] for each of its prefixes.
    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        for i in range(len(last), same, -1):
            node = path.pop()
            path[-1][1].append((last[i - 1], settle(node)))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        node = path.pop()
        path[-1][1].append((last[i - 1], settle(node)))
    start = settle(path[0])
    # States were settled children first, so counts can be summed in that order; the start becomes state 0.
    count, keys, targets, before = [], [], [], []
    name = lambda s: 0 if s == start else s + 1
    accepting = np.zeros(len(done) + 1, bool)
    for s, (final, edges) in enumerate(done):
        accepting[name(s)] = final
        n = int(final)
        for byte, t in edges:
            keys.append(name(s) * 256 + byte)
            targets.append(name(t))
            before.append(n)
            n += count[t]
        count.append(n)
    return np.array(keys, np.int64), np.array(targets, np.int64), np.array(before, np.int64), accepting


class Lexicon:
    """Words and their outputs (lists of ids), readable from one memory-mapped array."""

    def __init__(self, flat: np.ndarray):
        edges, states, words, ids = (int(x) for x in flat[:4])
        cut = np.cumsum([4, edges, edges, edges, states, words + 1, ids])
        keys, targets, before, self.accepting, self.starts, self.ids = (flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))
        self.edges = IntTable(np.asarray(keys), np.arange(edges))
        self.targets, self.before = targets, before

    @staticmethod
    def build(outputs: dict[bytes, list[int]]) -> np.ndarray:
        words = sorted(outputs)
        keys, targets, before, accepting = compile_words(words)
        starts = np.concatenate([[0], np.cumsum([len(outputs[w]) for w in words])]).astype(np.int64)
        ids = np.array([i for w in words for i in outputs[w]], np.int64)
        return np.concatenate([[len(keys), len(accepting), len(words), len(ids)], keys, targets, before, accepting.astype(np.int64), starts, ids])

    def ranks(self, chars: np.ndarray) -> np.ndarray:
        """Rank of each row of a byte matrix, -1 for words not in the lexicon."""
        state, rank = np.zeros(len(chars), np.int64), np.zeros(len(chars), np.int64)
        alive = np.arange(len(chars))
        for column in chars.T:
            edge = self.edges.get(state[alive] * 256 + column[alive])
            alive, edge = alive[edge >= 0], edge[edge >= 0]
            state[alive] = self.targets[edge]
            rank[alive] += self.before[edge]
        out = np.full(len(chars), -1, np.int64)
        ok = alive[self.accepting[state[alive]] > 0]
        out[ok] = rank[ok]
        return out
