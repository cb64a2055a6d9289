"""Lossless float planes: fields of the float are differenced apart, then each byte plane is coded on its own."""

from __future__ import annotations

import numpy as np

from .bits import Corrupt, Cursor, code_lengths, packbits_decode, packbits_encode, prefix_decode, prefix_encode, prefix_size

#: The most byte differences of a plane; how each plane's stream starts.
MAX_LEVEL = 5
CODED, CONSTANT, STORED, PACKED = 0, 1, 2, 3


def rotate(x: np.ndarray) -> np.ndarray:
    """32-bit floats as integers with the exponent in the top byte and the sign below it."""
    return ((x & np.uint32(0x7F800000)) << np.uint32(1)) | ((x >> np.uint32(31)) << np.uint32(23)) | (x & np.uint32(0x007FFFFF))


def unrotate(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint32(1)) & np.uint32(0x7F800000)) | (((x >> np.uint32(23)) & np.uint32(1)) << np.uint32(31)) | (x & np.uint32(0x007FFFFF))


def _fields(x: np.ndarray):
    """(mask of the low field, mask of the high field) of the rotated type."""
    low = 23 if x.dtype.itemsize == 4 else 52
    one = x.dtype.type(1)
    mask = (one << x.dtype.type(low)) - one
    return mask, ~mask


def difference(x: np.ndarray, axis: int) -> np.ndarray:
    """Both fields less those of the value before, along an axis, each wrapping in its own bits."""
    low, high = _fields(x)
    prev = np.zeros_like(x)
    to, of = [slice(None)] * 2, [slice(None)] * 2
    to[axis], of[axis] = slice(1, None), slice(None, -1)
    prev[tuple(to)] = x[tuple(of)]
    return ((x & high) - (prev & high) & high) | ((x & low) - (prev & low) & low)


def accumulate(x: np.ndarray, axis: int) -> np.ndarray:
    """The inverse of :func:`difference`: running sums of both fields."""
    low, high = _fields(x)
    sums = lambda m: np.cumsum(x & m, axis=axis, dtype=x.dtype) & m
    return sums(high) | sums(low)


def entropy(x: np.ndarray) -> float:
    n = np.bincount(x, minlength=256)
    n = n[n > 0]
    return float((n * np.log2(len(x) / n)).sum()) / 8


def encode_plane(plane: np.ndarray) -> bytes:
    """The smallest of: one repeated byte, coded, packed runs, as it is."""
    raw = plane.tobytes()
    counts = np.bincount(plane, minlength=256)
    if counts.max() == len(plane):
        return bytes([CONSTANT, raw[0]]) + len(plane).to_bytes(4, "little")
    options = [bytes([STORED]) + raw, bytes([PACKED]) + packbits_encode(raw)]
    lengths = code_lengths(counts)
    if lengths is not None and prefix_size(counts, lengths) < min(map(len, options)):
        options.append(bytes([CODED]) + prefix_encode(plane.astype(np.int64), lengths, 5))
    return min(options, key=len)


def decode_plane(raw: bytes, n: int) -> np.ndarray:
    kind = raw[0] if raw else None
    if kind == CONSTANT and len(raw) >= 6:
        return np.full(n, raw[1], np.uint8)
    if kind == STORED and len(raw) == n + 1:
        return np.frombuffer(raw, np.uint8, n, 1).copy()
    if kind == PACKED:
        return np.frombuffer(packbits_decode(raw[1:], n), np.uint8).copy()
    if kind == CODED:
        return prefix_decode(Cursor(raw, 1), n, 5).astype(np.uint8)
    raise Corrupt("unknown coding of a byte plane")


def byte_difference(x: np.ndarray, level: int) -> np.ndarray:
    for k in range(1, level + 1):
        x = np.concatenate([x[:k], x[k:] - x[k - 1 : -1]])
    return x


def byte_restore(x: np.ndarray, level: int) -> np.ndarray:
    for k in range(level, 0, -1):
        x = np.concatenate([x[: k - 1], np.cumsum(x[k - 1 :], dtype=np.uint8)])
    return x


def encode(values: np.ndarray) -> bytes:
    """All values of a (rows, cols) float array. The predictor (none, along rows, along rows and columns) and each plane's
    level of byte differences are those of the least entropy."""
    x = values.view(np.uint32 if values.dtype.itemsize == 4 else np.uint64)
    x = rotate(x) if x.dtype.itemsize == 4 else x
    row = difference(x, 1)
    options = [x, row, difference(row, 0)]
    planes_of = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    best = min(range(3), key=lambda i: sum(entropy(p) for p in planes_of(options[i])))
    out = [bytes([best])]
    for k, plane in enumerate(planes_of(options[best])):
        level, cost, now = 0, entropy(plane), plane
        while level < MAX_LEVEL - best and len(plane) > level + 1:
            now = byte_difference(plane, level + 1)
            if (e := entropy(now)) >= cost:
                break
            level, cost = level + 1, e
        raw = encode_plane(np.ascontiguousarray(byte_difference(plane, level)))
        out.append(bytes([k, level]) + len(raw).to_bytes(4, "little") + raw)
    return b"".join(out)


def decode(c: Cursor, kind: str, rows: int, cols: int) -> np.ndarray:
    size, n = np.dtype(kind).itemsize, rows * cols
    predictor = c.byte()
    if predictor > 2:
        raise Corrupt("unknown predictor")
    planes = np.zeros((n, size), np.uint8)
    for _ in range(size):
        k, level = c.byte(), c.byte()
        length = int.from_bytes(c.take(4), "little")
        if k >= size or level > MAX_LEVEL:
            raise Corrupt("a bad byte plane")
        planes[:, k] = byte_restore(decode_plane(c.take(length), n), level)
    x = planes.view(np.uint32 if size == 4 else np.uint64).reshape(rows, cols)
    if predictor == 2:
        x = accumulate(x, 0)
    if predictor:
        x = accumulate(x, 1)
    x = unrotate(x) if size == 4 else x
    return np.ascontiguousarray(x).view(kind)
