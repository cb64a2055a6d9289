"""Decoding of the first format: a count raster and a float raster, each in tiles."""

from __future__ import annotations

import struct

import numpy as np

from .bits import Corrupt, Cursor, rle_decode, unpack_old

OLD_KEY = b"CntZImage "
VERSION, IMAGE_TYPE, LARGEST_SIDE = 11, 8, 20000


def _short_float(c: Cursor, code: int) -> float:
    kinds = {0: "<f4", 1: "<i2", 2: "i1"}
    if code not in kinds:
        raise Corrupt("unknown type of an offset")
    return float(c.array(kinds[code], 1)[0])


def _stuffed(c: Cursor) -> np.ndarray:
    first = c.byte()
    code, bits = first >> 6, first & 63
    if code == 3 or bits >= 32:
        raise Corrupt("a bad block")
    n = int.from_bytes(c.take({0: 4, 1: 2, 2: 1}[code]), "little")
    return unpack_old(c.take((n * bits + 7) // 8), n, bits)


def _tiles(rows: int, cols: int, down: int, across: int):
    """Tiles of equal size and what is left over at the end of each side."""
    if not 0 < down <= rows or not 0 < across <= cols:
        raise Corrupt("bad tiling")
    cut = lambda n, k: [(i * (n // k), (i + 1) * (n // k)) for i in range(k)] + ([(k * (n // k), n)] if n % k else [])
    for i0, i1 in cut(rows, down):
        for j0, j1 in cut(cols, across):
            yield slice(i0, i1), slice(j0, j1)


def _part(c: Cursor):
    down, across, size = struct.unpack("<3i", c.take(12))
    top = struct.unpack("<f", c.take(4))[0]
    return down, across, top, Cursor(c.take(size))


def _counts(c: Cursor, rows: int, cols: int) -> np.ndarray:
    down, across, top, body = _part(c)
    if not down and not across:
        if not body.end:
            return np.full((rows, cols), top, np.float32)
        bits = np.unpackbits(np.frombuffer(rle_decode(body, (rows * cols + 7) // 8), np.uint8), count=rows * cols)
        return bits.reshape(rows, cols).astype(np.float32)
    out = np.zeros((rows, cols), np.float32)
    for tile in _tiles(rows, cols, down, across):
        view, flag = out[tile], body.byte()
        if flag in (2, 3, 4):
            view[:] = {2: 0, 3: -1, 4: 1}[flag]
        elif flag == 0:
            view[:] = body.array("<f4", view.size).reshape(view.shape)
        elif flag & 63 == 1:
            low = _short_float(body, flag >> 6)
            view[:] = low + _stuffed(body)[: view.size].reshape(view.shape).astype(np.float32)
        else:
            raise Corrupt("a bad count tile")
    return out


def _values(c: Cursor, valid: np.ndarray, error: float) -> np.ndarray:
    rows, cols = valid.shape
    down, across, top, body = _part(c)
    out = np.zeros((rows, cols), np.float32)
    for tile in _tiles(rows, cols, down, across):
        view, m, first = out[tile], valid[tile], body.byte()
        n, flag = int(m.sum()), first & 63
        if flag == 2:
            continue
        if flag == 0:
            view[m] = body.array("<f4", n)
        elif flag in (1, 3):
            low = _short_float(body, first >> 6)
            if flag == 3:
                view[m] = low
            else:
                view[m] = np.minimum((low + _stuffed(body)[:n] * (2 * error)).astype(np.float32), np.float32(top))
        else:
            raise Corrupt("a bad value tile")
    return out


def decode_old(data: bytes, bands: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values as float32 (bands, rows, cols, 1), mask). The first band has counts and values, later ones values only."""
    c, zs, valid, extent = Cursor(data), [], None, None
    while c.at < len(data) and (bands is None or len(zs) < bands):
        if c.take(len(OLD_KEY)) != OLD_KEY:
            raise Corrupt("no blob starts here")
        version, kind, rows, cols = struct.unpack("<4i", c.take(16))
        error = struct.unpack("<d", c.take(8))[0]
        if version != VERSION or kind != IMAGE_TYPE or not 0 < rows <= LARGEST_SIDE or not 0 < cols <= LARGEST_SIDE or (extent and extent != (rows, cols)):
            raise Corrupt("a header out of range")
        extent = (rows, cols)
        if valid is None:
            valid = _counts(c, rows, cols) > 0
        zs.append(_values(c, valid, error))
    if not zs or (bands is not None and len(zs) < bands):
        raise Corrupt("fewer bands than asked for")
    return np.stack(zs)[..., None], np.broadcast_to(valid, (len(zs), *valid.shape)).copy()


def as_type(z: np.ndarray, kind: str) -> np.ndarray:
    """Old float values as another type: integers are rounded half up."""
    return z.astype(kind) if np.dtype(kind).kind == "f" else np.floor(z.astype(np.float64) + 0.5).astype(kind)
