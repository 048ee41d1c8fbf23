"""Suffix arrays by linear grouping, and repeated windows in a batch of byte blocks.

``suffix_array`` groups suffixes by their longest Lyndon prefix.  Groups are
taken in descending order; each member finds its previous smaller group, and
suffixes that are pointed at move to a new, larger group behind their own.  A
second pass emits all suffixes in order: the next smaller suffix of each is
already placed, so every group fills from its front.  Nothing is renamed
recursively.

``repeated_windows`` applies it to blocks of bytes.  The bytes are first cut
into phrases at places that the content chooses; the array is built over the
phrases, and the order of every byte position follows from the rest of its
phrase and the rank of the phrase after it.
"""

from __future__ import annotations

import numpy as np

from . import textnum

#: Bytes that decide whether a phrase starts, and one start in how many places.
TRIGGER, SPACING = 4, 8
SEPARATOR = b"\xff"


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (non-negative) in lexicographic order; a suffix precedes those it is a prefix of."""
    s = [x + 1 for x in symbols]
    s.append(0)
    n = len(s)
    # Groups in a linked list by rank; a member that moved on stays in its old list and is skipped there.
    order = sorted(set(s))
    name = {c: g for g, c in enumerate(order)}
    group = [name[c] for c in s]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(order) - 1))
    above = [*range(1, len(order)), -1]
    done = [False] * len(order)
    previous = [-1] * n
    g = len(order) - 1
    while g >= 0:
        done[g] = True
        pointed: dict[int, int] = {}
        kept = [i for i in members[g] if group[i] == g]
        members[g] = kept
        for i in kept:
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            most = max(pointed.values())
            # More pointers mean a longer run of this group's prefix behind the suffix, so a larger group.
            levels: list[dict[int, list[int]]] = [{} for _ in range(most + 1)]
            for j, times in pointed.items():
                levels[times].setdefault(group[j], []).append(j)
            for level in reversed(levels):
                for old, moved in level.items():
                    new = len(members)
                    moved.sort()
                    members.append(moved)
                    done.append(False)
                    up = above[old]
                    above[old] = new
                    below.append(old)
                    above.append(up)
                    if up >= 0:
                        below[up] = new
                    for j in moved:
                        group[j] = new
        g = below[g]
    front, at, g = [0] * len(members), 0, group[n - 1]
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = previous[j]
    return out[1:]


def repeated_windows(blocks: list[bytes], width: int) -> list[np.ndarray]:
    """For each block a flag for each of its windows of ``width`` bytes: whether the same bytes start elsewhere in the blocks.

    Blocks must not hold the separator byte, which UTF-8 has not.
    """
    size = np.array([len(b) for b in blocks], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    text = SEPARATOR.join(blocks) + SEPARATOR * (2 * TRIGGER)
    data = np.frombuffer(text, np.uint8)
    pre = textnum.prefix(textnum.BYTE[data])
    last = len(data) - TRIGGER
    at = np.arange(last)
    cut = (textnum.spans_hash(pre, at, at + TRIGGER) % np.uint64(SPACING)) == 0
    cut[begin[begin < last]] = True
    cut[0] = True
    starts = np.flatnonzero(cut)
    ends = np.minimum(np.append(starts[1:] + TRIGGER, len(data)), len(data))
    phrases = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    number = {p: i for i, p in enumerate(sorted(set(phrases)))}
    array = suffix_array([number[p] for p in phrases])
    rank = np.empty(len(phrases) + 1, np.int64)
    rank[array] = np.arange(len(phrases))
    rank[len(phrases)] = -1
    count = np.maximum(0, size - width + 1)
    where = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    flags = np.zeros(len(where), bool)
    if len(where):
        phrase = np.searchsorted(starts, where, side="right") - 1
        rests = [text[a:b] for a, b in zip(where.tolist(), ends[phrase].tolist(), strict=True)]
        number = {p: i for i, p in enumerate(sorted(set(rests)))}
        order = np.lexsort((rank[phrase + 1], np.array([number[p] for p in rests])))
        sorted_ = where[order]
        h = textnum.spans_hash(pre, sorted_, sorted_ + width)
        same = np.flatnonzero(h[1:] == h[:-1])
        # Equal hashes are confirmed on the bytes.
        for part in np.array_split(same, max(1, len(same) // 4096)):
            a, b = sorted_[part][:, None] + np.arange(width), sorted_[part + 1][:, None] + np.arange(width)
            ok = part[(data[a] == data[b]).all(axis=1)]
            flags[order[ok]] = flags[order[ok + 1]] = True
    return np.split(flags, np.cumsum(count)[:-1])
