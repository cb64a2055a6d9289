"""Bit-level pieces of the blob format, vectorised: bit stuffing, runs, prefix codes, checksums."""

from __future__ import annotations

import heapq

import numpy as np


class Corrupt(ValueError):
    """The bytes are not a blob of the format, or are damaged."""


class Cursor:
    """Reads from bytes, never past their end."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Corrupt("the blob ends too early")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def array(self, kind, n: int) -> np.ndarray:
        return np.frombuffer(self.take(n * np.dtype(kind).itemsize), kind)

    def byte(self) -> int:
        return self.take(1)[0]


def fletcher32(data: bytes) -> int:
    """Fletcher's checksum over big-endian 16-bit words, by closed-form weighted sums modulo 65535."""
    whole = np.frombuffer(data, ">u2", len(data) // 2).astype(np.uint64)
    if len(data) % 2:
        whole = np.append(whole, np.uint64(data[-1] << 8))
    n = len(whole)
    a = 0xFFFF + int(whole.sum())
    weight = (np.arange(n, 0, -1, dtype=np.uint64)) % np.uint64(65535)
    b = 0xFFFF + n * 0xFFFF + int((weight * whole % np.uint64(65535)).sum())
    fold = lambda x: (x - 1) % 65535 + 1  # noqa: E731  sums start at 65535, so 0 is written as 65535
    return fold(b) << 16 | fold(a)


def width_of(top: int) -> int:
    return int(top).bit_length()


def pack(values: np.ndarray, bits: int) -> bytes:
    """Values of ``bits`` bits each, lowest bit first, without padding to words."""
    v = np.asarray(values, np.uint32)
    if not bits or not len(v):
        return b""
    return np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.uint32)
    b = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return b.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack_old(values: np.ndarray, bits: int) -> bytes:
    """Before version 3: highest bit first into 32-bit words, the last word shifted down to the bytes it needs."""
    v = np.asarray(values, np.uint32)
    if not bits or not len(v):
        return b""
    b = np.packbits(((v[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1).astype(np.uint8).ravel())
    need = len(b)
    words = np.frombuffer(b.tobytes() + bytes(-need % 4), ">u4").astype(np.uint32)
    words[-1] >>= 8 * (-need % 4)
    return words.astype("<u4").tobytes()[:need]


def unpack_old(raw: bytes, n: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.uint32)
    words = np.frombuffer(raw + bytes(-len(raw) % 4), "<u4").astype(np.uint32)
    words[-1] <<= 8 * (-len(raw) % 4)
    b = np.unpackbits(words.astype(">u4").view(np.uint8), count=n * bits).reshape(n, bits)
    return b.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


_COUNT = {1: 2, 2: 1, 4: 0}  # bytes of a count -> its code in the two top bits


def _head(bits: int, n: int, lut: bool) -> bytes:
    size = 1 if n < 256 else 2 if n < 65536 else 4
    return bytes([bits | lut << 5 | _COUNT[size] << 6]) + n.to_bytes(size, "little")


def stuff(values: np.ndarray, version: int = 6) -> bytes:
    """A block of unsigned integers with their count, all at the width of the largest."""
    bits = width_of(values.max() if len(values) else 0)
    return _head(bits, len(values), False) + (pack if version >= 3 else pack_old)(values, bits)


def stuff_lut(values: np.ndarray, version: int = 6) -> bytes | None:
    """The same with a dictionary of the different values; None where there can be none. 0 is always in it and not stored."""
    table, index = np.unique(values, return_inverse=True)
    if table[0] != 0 or not 2 <= len(table) <= 255:
        return None
    bits, put = width_of(table[-1]), pack if version >= 3 else pack_old
    return _head(bits, len(values), True) + bytes([len(table)]) + put(table[1:], bits) + put(index, width_of(len(table) - 1))


def unstuff(c: Cursor, most: int, version: int = 6) -> np.ndarray:
    """The values of a stuffed block, at most ``most``."""
    first = c.byte()
    bits, lut, code = first & 31, first & 32, first >> 6
    if code == 3:
        raise Corrupt("unknown size of a count")
    n = int.from_bytes(c.take(4 if code == 0 else 3 - code), "little")
    if n > most:
        raise Corrupt("more values than the block has room for")
    get = unpack if version >= 3 else unpack_old
    if not lut:
        return get(c.take((n * bits + 7) // 8), n, bits)
    size = c.byte()
    if not bits or size < 2:
        raise Corrupt("an empty dictionary")
    table = np.concatenate([[0], get(c.take(((size - 1) * bits + 7) // 8), size - 1, bits)]).astype(np.uint32)
    wide = width_of(size - 1)
    index = get(c.take((n * wide + 7) // 8), n, wide)
    if len(index) and index.max() >= size:
        raise Corrupt("an index past the dictionary")
    return table[index]


# ---------------------------------------------------------------- runs


def rle_encode(data: bytes, least: int = 5, most: int = 32767, end: int = -32768) -> bytes:
    """Runs as signed 16-bit counts: n > 0 literal bytes, or n < 0 and the byte that comes -n times."""
    x = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero(np.diff(x)) + 1 if len(x) else np.zeros(0, np.int64)
    starts, ends = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(x)]]).astype(int)
    out, literal = [], 0  # literal: where bytes not yet written start

    def flush(to):
        nonlocal literal
        while literal < to:
            n = min(most, to - literal)
            out.append(n.to_bytes(2, "little", signed=True) + data[literal : literal + n])
            literal += n

    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= least:
            flush(a)
            while b - literal >= least:
                n = min(most, b - literal)
                out.append((-n).to_bytes(2, "little", signed=True) + data[literal : literal + 1])
                literal += n
    flush(len(x))
    return b"".join(out) + end.to_bytes(2, "little", signed=True)


def rle_decode(c: Cursor, size: int) -> bytes:
    out, have = [], 0
    while (n := int.from_bytes(c.take(2), "little", signed=True)) != -32768:
        have += abs(n)
        if have > size:
            raise Corrupt("runs longer than the mask")
        out.append(c.take(n) if n >= 0 else c.take(1) * -n)
    if have != size:
        raise Corrupt("runs shorter than the mask")
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    """Up to 128 literal bytes after their number less 1, or 127 + r and a byte that comes r + 1 times (r up to 128)."""
    x = np.frombuffer(data, np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]).astype(int) if len(x) else np.zeros(1, int)
    out, held = [], bytearray()

    def flush():
        for i in range(0, len(held), 128):
            out.append(bytes([len(held[i : i + 128]) - 1]) + held[i : i + 128])
        held.clear()

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        while b - a > 1:
            flush()
            n = min(129, b - a)
            out.append(bytes([126 + n, data[a]]))
            a += n
        if b > a:
            held.append(data[a])
    flush()
    return b"".join(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, c, have = [], Cursor(raw), 0
    while have < size:
        n = c.byte()
        out.append(c.take(n + 1) if n < 128 else c.take(1) * (n - 126))
        have += len(out[-1])
    if have != size:
        raise Corrupt("runs don't give the length")
    return b"".join(out)


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray) -> np.ndarray | None:
    """Lengths of an optimal prefix code; None for fewer than two used symbols or a code longer than 32 bits."""
    used = np.flatnonzero(counts)
    if len(used) < 2:
        return None
    heap = [(int(counts[s]), int(s), (int(s),)) for s in used]
    heapq.heapify(heap)
    out = np.zeros(len(counts), np.int64)
    while len(heap) > 1:
        (n, i, a), (m, j, b) = heapq.heappop(heap), heapq.heappop(heap)
        out[list(a + b)] += 1
        heapq.heappush(heap, (n + m, min(i, j), a + b))
    return out if out.max() <= 32 else None


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length alone: the longest ones count up from 0 in order of symbol; going to shorter ones drops low bits."""
    codes, code, now = np.zeros(len(lengths), np.uint32), 0, int(lengths.max())
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (-int(lengths[s]), int(s))):
        code >>= now - int(lengths[s])
        now = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def used_range(lengths: np.ndarray) -> tuple[int, int]:
    """The shortest stretch begin to end - 1 of symbols, end perhaps past the last one and then counted on from the first, that holds all used ones."""
    used, size = np.flatnonzero(lengths), len(lengths)
    gaps = np.diff(np.append(used, used[0] + size))
    k = int(gaps.argmax())
    if k == len(used) - 1:
        return int(used[0]), int(used[-1]) + 1
    return int(used[k + 1]), int(used[k]) + 1 + size


def _bit_words(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes in a row, highest bit first, in little-endian 32-bit words."""
    total = int(lengths.sum())
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(total) - start
    bit = (np.repeat(codes.astype(np.uint64), lengths) >> (np.repeat(lengths, lengths) - 1 - at).astype(np.uint64)) & np.uint64(1)
    raw = np.packbits(bit.astype(np.uint8)).tobytes()
    return np.frombuffer(raw + bytes(-len(raw) % 4), ">u4").astype("<u4").tobytes()


def prefix_encode(symbols: np.ndarray, lengths: np.ndarray, version: int = 6) -> bytes:
    """Code table and coded symbols (with one word more, which decoders may read ahead into)."""
    size, codes = len(lengths), canonical(lengths)
    begin, end = used_range(lengths)
    at = np.arange(begin, end) % size
    some = at[lengths[at] > 0]
    head = np.array([4, size, begin, end], "<i4").tobytes() + stuff(lengths[at].astype(np.uint32), version) + _bit_words(codes[some], lengths[some])
    return head + _bit_words(codes[symbols], lengths[symbols]) + bytes(4)


def prefix_size(counts: np.ndarray, lengths: np.ndarray) -> int:
    """The bytes :func:`prefix_encode` would give."""
    begin, end = used_range(lengths)
    words = lambda bits: 4 * -(-int(bits) // 32)
    at = np.arange(begin, end) % len(lengths)
    return 16 + len(stuff(lengths[at].astype(np.uint32))) + words(lengths.sum()) + words((counts * lengths).sum()) + 4


def prefix_decode(c: Cursor, n: int, version: int = 6, last: bool = False) -> np.ndarray:
    """n symbols. Every bit position is decoded at once (codes left-aligned to 32 bits are in order of value, so a search finds
    the symbol), then the positions really used are followed."""
    form, size, begin, end = (int(x) for x in c.array("<i4", 4))
    if form < 2 or not 0 <= begin < end or not 0 < size <= 1 << 15 or end - begin > size or end > 2 * size:
        raise Corrupt("a bad code table")
    got = unstuff(c, end - begin, version).astype(np.int64)
    if len(got) != end - begin or got.max() > 32:
        raise Corrupt("a bad code table")
    symbols = (np.arange(begin, end) % size)[got > 0]
    lengths = got[got > 0]
    if len(symbols) == 0:
        raise Corrupt("a bad code table")
    words = c.array("<u4", -(-int(lengths.sum()) // 32)).astype(">u4").view(np.uint8)
    bits = np.unpackbits(words)
    codes, at = [], 0
    for k in lengths.tolist():
        codes.append(int("".join(map(str, bits[at : at + k].tolist())), 2) << (32 - k))
        at += k
    order = np.argsort(codes, kind="stable")
    left, symbols, lengths = np.array(codes, np.uint64)[order], symbols[order], lengths[order]
    rest = c.data[c.at : c.end - (c.end - c.at) % 4]
    data = np.frombuffer(rest, "<u4").astype(">u4").view(np.uint8)
    need, out = min(8 * len(data), 32 * n + 64), np.empty(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    done, pos, step = 0, 0, 1 << 18
    while done < n:  # a stretch of bit positions at a time
        stop = min(need, pos + step)
        if pos >= stop:
            raise Corrupt("the coded values end too early")
        p = np.arange(pos, stop)
        b = p >> 3
        window = (padded[b] << np.uint64(32)) | (padded[b + 1] << np.uint64(24)) | (padded[b + 2] << np.uint64(16)) | (padded[b + 3] << np.uint64(8)) | padded[b + 4]
        window = (window >> (np.uint64(8) - (p & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)
        found = np.searchsorted(left, window, "right") - 1
        jump, base = lengths[found].tolist(), pos
        path = []
        while pos < stop and done + len(path) < n:
            path.append(pos - base)
            pos += jump[pos - base]
        out[done : done + len(path)] = symbols[found[path]]
        done += len(path)
    c.take(4 * (-(-pos // 32)))
    if c.at + 4 <= c.end:
        c.take(4)  # the word to read ahead into
    return out
