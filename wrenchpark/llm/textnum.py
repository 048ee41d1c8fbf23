"""Numpy views of Arrow text: bytes, words, lines and rolling hashes over a whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_pow = {"n": 0}
#: ASCII white space and A-Z folded to a-z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n+1 offsets; null counts as empty."""
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = pc.fill_null(col, "")
    else:
        col = pc.fill_null(col, b"")
    col = col.cast(pa.large_binary())
    _, ob, db = col.buffers()
    off = np.frombuffer(ob, np.int64)[col.offset:col.offset + len(col) + 1] if ob else np.zeros(1, np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None and db.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = max(n, 1 << 20)
        for name, r in (("p", _R), ("q", _RINV)):
            a = np.full(m, r, np.uint64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
        _pow["n"] = m
    return _pow["p"][:n], _pow["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (splitmix64's finisher)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * r^j for j < i, modulo 2^64."""
    p, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:len(values)], out=out[1:], dtype=np.uint64)
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled hash of values[start:end], the same for equal contents at any place."""
    _, q = _powers(len(pre))
    return mix((pre[end] - pre[start]) * q[start] + (end - start).astype(np.uint64))


#: Scrambled byte values, so that the polynomial's coefficients are 64-bit.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes that are not ASCII white space."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ok = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[off[:-1][off[:-1] < n]] = True
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | first[1:n]
    stop = np.empty(n, bool)
    stop[-1] = ok[-1]
    stop[:-1] = ok[:-1] & (~ok[1:] | first[1:n])
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, hash of k consecutive words), A-Z folded; a document of fewer words has them all as one."""
    s, e, d = words(data, off)
    if not len(s):
        z = np.zeros(0, np.uint64)
        return z.astype(np.int64), z
    h = spans_hash(prefix(BYTE[LOWER[data]]), s, e)
    n_docs = len(off) - 1
    count = np.bincount(d, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    pre = prefix(h)
    rank = np.arange(len(s)) - first[d]
    at = np.flatnonzero((rank + k <= count[d]) | ((rank == 0) & (count[d] < k)))
    doc = d[at]
    hashes = spans_hash(pre, at, at + np.minimum(k, count[doc]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]
