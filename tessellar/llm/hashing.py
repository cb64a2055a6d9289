"""Word hashes of whole Arrow string columns at once, without a Python object for any word.

A word's 64-bit hash is ``sum(T[byte_j] * R**j)`` over its bytes (T a fixed random table, R odd), computed from running sums over the
column's bytes: ``(S[end] - S[begin]) * R**-begin`` in arithmetic modulo 2**64, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_T = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(_R, _STEP), _powers(_R_INV, _STEP)

#: Bytes that separate words: ASCII blanks only, or all ASCII but letters and digits.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, bool)
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of splitmix64, a public-domain generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of a string column: hash, begin and end (byte offsets in ``data``) of each, ``first[i]`` to ``first[i + 1] - 1`` those of row i.

    Letters A-Z are lower-cased unless ``fold`` is false; with ``latin``, accented capitals of Latin-1 too. A null row has no words."""

    def __init__(self, column: pa.Array, separators: np.ndarray = BLANKS, latin: bool = False, fold: bool = True):
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        column = column.fill_null("")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset) if n else np.zeros(1, np.int32)
        raw = column.buffers()[2]
        base = int(offsets[0])
        data = np.frombuffer(raw, np.uint8)[base : int(offsets[-1])] if raw is not None and offsets[-1] > base else np.zeros(0, np.uint8)
        self.offsets = offsets.astype(np.int64) - base
        self.data = _LOWER[data] if fold else data
        if latin and len(data):
            up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
            self.data[up] += 32
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True  # a word ends where its row ends
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        self.begin = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.begin, self.offsets)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.begin), np.uint64)
        done, at, size = 0, 0, len(self.data)
        while done < len(self.begin):  # pieces of whole words, of about _STEP bytes: the tables of powers stay small
            at = int(self.begin[done])
            last = max(int(np.searchsorted(self.end, at + _STEP, "right")), done + 1)
            stop = min(size, int(self.end[last - 1]))
            up, down = (_UP, _DOWN) if stop - at <= _STEP else (_powers(_R, stop - at), _powers(_R_INV, stop - at))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_T[self.data[at:stop]] * up[: stop - at])])
            b, e = self.begin[done:last] - at, self.end[done:last] - at
            out[done:last] = (total[e] - total[b]) * down[b]
            done = last
        return mix(out)

    def text(self, i: int, j: int) -> str:
        """Words i to j - 1, as they stand between them."""
        return self.data[self.begin[i] : self.end[j - 1]].tobytes().decode("utf-8", "replace") if j > i else ""

    def grams(self, n: int) -> np.ndarray:
        """A hash for each word: that of the n words from it on (of no use where they pass the end of the row)."""
        out = np.zeros(len(self.hash), np.uint64)
        m = max(0, len(self.hash) - n + 1)
        for k in range(n):
            out[:m] = out[:m] * _U(0xD6E8FEB86659FD93) + self.hash[k : k + m]
        return mix(out)

    def whole(self, i: int) -> np.uint64:
        """The hash of all words of row i, for rows with fewer words than an n-gram; unlike that of any n-gram."""
        h = np.zeros(1, np.uint64)
        for x in self.hash[self.first[i] : self.first[i + 1]]:
            h = h * _U(0xD6E8FEB86659FD93) + x
        n = np.array([self.first[i + 1] - self.first[i]], np.uint64)
        return mix(h + n * _U(0xA24BAED4963EE407))[0]


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted different n-word shingles of the row's blank-separated lower-cased words."""
    w = Words(column)
    grams, out = w.grams(n), []
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(np.array([w.whole(i)], np.uint64) if b > a else np.zeros(0, np.uint64))
    return out
