"""Ids of words, remembered by a worker in flat arrays, so that all words of a batch are looked up at once."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from .hashing import BLANKS, mix

_U = np.uint64
#: A key holds up to this many bytes of a word, and their number: equal keys are equal words.
KEY_BYTES = 15
_ONES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Table:
    """(64-bit, 64-bit) keys -> positions 0, 1, 2, ... in the order of insertion; open addressing in flat arrays."""

    def __init__(self, limit: int):
        self.bits = max(4, (2 * limit).bit_length())
        self.mask, self.shift, self.limit = (1 << self.bits) - 1, _U(64 - self.bits), limit
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.a, self.b, self.size = np.zeros(limit, np.uint64), np.zeros(limit, np.uint64), 0

    def _home(self, a, b):
        return (mix(a ^ (b * _U(0x9E3779B97F4A7C15))) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The position of each key, -1 for unknown ones."""
        out = np.full(len(a), -1, np.int32)
        slot, todo = self._home(a, b), None
        while True:
            at = self.at[slot]
            of = np.maximum(at, 0)
            x, y = (a, b) if todo is None else (a[todo], b[todo])
            hit = (at >= 0) & (self.a[of] == x) & (self.b[of] == y)
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero((at >= 0) & ~hit)
                slot = slot[todo]
            else:
                out[todo[hit]] = at[hit]
                on = (at >= 0) & ~hit
                todo, slot = todo[on], slot[on]
            if not len(todo):
                return out
            slot = (slot + 1) & self.mask

    def insert(self, a: np.ndarray, b: np.ndarray) -> None:
        """Different keys that aren't in the table, as many as it has room for."""
        new = np.arange(self.size, self.size + len(a), dtype=np.int32)
        self.a[new], self.b[new] = a, b
        self.size += len(a)
        slot = self._home(a, b)
        while len(new):
            free = self.at[slot] < 0
            self.at[slot[free]] = new[free]
            placed = self.at[slot] == new
            new, slot = new[~placed], (slot[~placed] + 1) & self.mask


def word_keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of words of ``data``: all bytes of those with up to KEY_BYTES, and their number."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 8,), "<u8", padded.data, strides=(1,)).copy()
    a = eight[begin] & _ONES[np.minimum(size, 8)]
    b = (eight[np.minimum(begin + 8, len(data))] & _ONES[np.clip(size - 8, 0, 7)]) | size.astype(np.uint64) << _U(56)
    return a, b


class Numbers:
    """Different words of a stretch of text, numbered from 0 in the order in which they are met; grows as needed."""

    def __init__(self):
        self.table, self.number, self.words, self.long = Table(1 << 16), np.zeros(1 << 16, np.int64), [], {}

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        a, b = word_keys(data, begin, size)
        raw, short = data.tobytes(), size <= KEY_BYTES
        at = self.table.find(a, b) if len(a) else np.zeros(0, np.int32)
        new = np.flatnonzero((at < 0) & short)
        if len(new):
            by = new[np.lexsort((a[new], b[new]))]
            first = by[np.concatenate([[True], (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])])]
            while self.table.size + len(first) > self.table.limit:
                old, self.table = self.table, Table(2 * self.table.limit)
                self.table.insert(old.a[: old.size], old.b[: old.size])
                self.number = np.concatenate([self.number, np.zeros_like(self.number)])
            self.number[self.table.size : self.table.size + len(first)] = len(self.words) + np.arange(len(first))
            self.table.insert(a[first], b[first])
            self.words += [raw[i:j] for i, j in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
            at[new] = self.table.find(a[new], b[new])
        out = self.number[np.maximum(at, 0)]
        for i in np.flatnonzero(~short).tolist():
            w = raw[begin[i] : end[i]]
            if w not in self.long:
                self.long[w] = len(self.words)
                self.words.append(w)
            out[i] = self.long[w]
        return out


class WordIds:
    """The ids of texts by the ids of their words.

    ``encode`` gives the ids of one word (bytes); a word's ids must not depend on what stands around it. Words are what stands between
    ``separators`` (a bool for each of the 256 bytes); with ``lower``, words without other than ASCII bytes are lower-cased first. Up to ``limit`` different words of up to 15
    bytes are remembered (their bytes are the key, so that no two are confused); a full table forgets those asked for least recently.
    Longer words are encoded anew each time."""

    def __init__(self, encode, limit: int, separators: np.ndarray = BLANKS, lower: bool = False):
        self.encode, self.limit, self.inside = encode, limit, ~separators
        self.fold = None
        if lower:
            self.fold = np.arange(256, dtype=np.uint8)
            self.fold[65:91] += 32
        self._reset()

    def _reset(self):
        self.table, self.turn = Table(self.limit), 0
        self.start, self.n, self.used = np.zeros(self.limit, np.int64), np.zeros(self.limit, np.int32), np.zeros(self.limit, np.int32)
        self.flat, self.end = np.zeros(1 << 16, np.uint32), 0

    def _make_room(self, more: int):
        """Keep the half of the words that were used last, or nothing where even that leaves no room."""
        old, size = (self.table, self.start, self.n, self.flat, self.used), self.table.size
        keep = np.argsort(self.used[:size], kind="stable")[size // 2 + more :] if size // 2 + more < size else np.zeros(0, np.int64)
        turn = self.turn
        self._reset()
        self.turn = turn
        table, start, n, flat, used = old
        self._add(table.a[keep], table.b[keep], n[keep], flat[_ranges(start[keep], n[keep])])
        self.used[: len(keep)] = used[keep]

    def _folded(self, data, begin, end):
        """``data`` with the words of ASCII bytes alone in lower case."""
        if self.fold is None:
            return data
        out, high = self.fold[data], np.flatnonzero(data >= 128)
        if len(high):
            of = np.searchsorted(begin, high, "right") - 1
            of = np.unique(of[(of >= 0) & (high < end[of])])
            at = _ranges(begin[of], end[of] - begin[of])
            out[at] = data[at]
        return out

    def _add(self, a, b, n, ids):
        at, to = self.table.size, self.table.size + len(a)
        while self.end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.end : self.end + len(ids)] = ids
        self.start[at:to], self.n[at:to], self.used[at:to] = self.end + np.cumsum(n) - n, n, self.turn
        self.end += len(ids)
        self.table.insert(a, b)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string column in a row, number of ids of each text); a null text has none."""
        rows = len(column)
        offsets, data = flat_bytes(column)
        inside = self.inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends where its text ends
        before, after = np.concatenate([[False], inside]), np.concatenate([inside, [False]])
        begin, end = np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))
        size = end - begin
        data = self._folded(data, begin, end)
        a, b = word_keys(data, begin, size)
        short = size <= KEY_BYTES
        raw = data.tobytes()
        self.turn += 1
        at = self.table.find(a, b) if len(a) else np.zeros(0, np.int32)
        new, moved = np.flatnonzero((at < 0) & short), False
        if len(new):
            by = new[np.lexsort((a[new], b[new]))]
            first = by[np.concatenate([[True], (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])])]
            for k in range(0, len(first), self.limit // 4):
                some = first[k : k + self.limit // 4]
                if self.table.size + len(some) > self.limit:
                    self._make_room(len(some))
                    moved = True
                got = [self.encode(raw[i:j]) for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
                n = np.fromiter(map(len, got), np.int32, len(got))
                self._add(a[some], b[some], n, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())))
            if moved:
                at = self.table.find(a, b)
            else:
                at[new] = self.table.find(a[new], b[new])
        odd = np.flatnonzero(~short | (at < 0))  # long words, and those that made room for others of this batch
        at[odd] = 0
        self.used[at] = self.turn
        start, n = self.start[at], self.n[at].astype(np.int64)
        n[odd] = 0
        ids = self.flat[_ranges(start, n)]
        if len(odd):
            got = [self.encode(raw[i:j]) for i, j in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)]
            more = np.fromiter(map(len, got), np.int64, len(got))
            where = np.concatenate([[0], np.cumsum(n)])[odd]
            ids = np.insert(ids, np.repeat(where, more), np.fromiter(chain.from_iterable(got), np.uint32, int(more.sum())))
            n[odd] = more
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(total[np.searchsorted(begin, offsets)]) if rows else np.zeros(0, np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the rows and the end, bytes) of a string or binary column; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
