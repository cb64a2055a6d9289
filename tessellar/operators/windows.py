"""Random access into blobs: an index of where blocks begin, and windows read through it.

``index`` walks the heads of each blob once (a head says how long its block is) and gives a row a block, beside the blobs; all depths of a block stand together.
``read_window`` joins the blocks that a window of pixels touches to their blobs, cuts their bytes out in the JVM, and decodes nothing else. A band that isn't stored in
blocks (a constant, raw values, prefix codes, float planes) is one row that covers it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blob as codec
from ..functions.bits import Cursor, unstuff
from .blobs import PIXELS

INDEX = "tile bigint, row0 bigint, col0 bigint, band bigint, row bigint, col bigint, height bigint, width bigint, begin bigint, length bigint, whole boolean, version int, kind int, error double, tops array<double>, nodata array<double>, valid binary"


def _block_values(c: Cursor, kind: int, version: int, error: float, n: int, tops: list[float]) -> np.ndarray:
    """The (depth, n) values of a block from where ``c`` stands on, each depth's own or on top of the one below it, at most the depth's maximum."""
    out, dtype = np.zeros((len(tops), n)), np.dtype(codec.TYPES[kind])
    for d, top in enumerate(tops):
        flag = c.byte()
        differs, mode = version >= 5 and bool(flag & 4), flag & 3
        if mode == 0:
            out[d] = c.array(dtype, n)
            continue
        v = np.zeros(n)
        if mode != 2:
            of = 4 if differs and kind < 6 else kind
            v += float(c.array(codec.TYPES[codec.REDUCED.get(of, (of,))[flag >> 6]], 1)[0])
            if mode == 1:
                v += unstuff(c, max(n, 1 << 10), version)[:n] * (2 * error)
        if differs:
            v += out[d - 1]
        out[d] = np.minimum(v, top) if differs or mode == 1 else v
    return out.astype(dtype).astype(np.float64)


def _band_index(data: bytes, at: int, before):
    """(header, mask, rows of the index without tile and band) of the band whose blob starts at ``at``."""
    h, mask, (_, highs) = codec.decode_band(data, at, before, only_ranges=True)
    nodata = [h.nodata, h.nodata_orig] if h.uses_nodata and h.n_depth > 1 else []
    all_of_it = [(0, 0, h.n_rows, h.n_cols, at, h.size, True, h.version, h.kind, h.error, highs.tolist(), nodata, np.packbits(mask.ravel()).tobytes())]
    c = Cursor(data, at)
    codec.read_header(c)
    c.take(int.from_bytes(c.take(4), "little"))
    if not h.n_valid or h.z_min == h.z_max:
        return h, mask, all_of_it
    if h.version >= 4:
        lows = c.array(h.dtype, 2 * h.n_depth)[: h.n_depth]
        if (lows == highs).all():
            return h, mask, all_of_it
    if c.byte() or ((h.coded or h.planes) and c.byte() != codec.TILED):
        return h, mask, all_of_it
    out, tops = [], highs.tolist() if h.n_depth > 1 and h.version >= 4 else [h.z_max] * h.n_depth
    for r in range(0, h.n_rows, h.block):
        for k in range(0, h.n_cols, h.block):
            own, begin = mask[r : r + h.block, k : k + h.block], c.at
            _block_values(c, h.kind, h.version, h.error, int(own.sum()), tops)
            out.append((r, k, *own.shape, begin, c.at - begin, False, h.version, h.kind, h.error, tops, nodata, np.packbits(own.ravel()).tobytes()))
    return h, mask, out


def index(blobs: DataFrame) -> DataFrame:
    """One row a block (``INDEX``): tile, band, first row and column and extent in the raster, and where its bytes are in the tile's blob. A damaged blob fails the query."""
    schema = _arrow_schema(INDEX)

    def run(batches):
        for b in batches:
            out = []
            for tile, row0, col0, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                at, band, before = 0, 0, None
                while at < len(data):
                    h, before, found = _band_index(data, at, before)
                    out += [(tile, row0, col0, band, row0 + r, col0 + k, *rest) for r, k, *rest in found]
                    at, band = at + h.size, band + 1
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return blobs.filter("blob is not null").select("tile", "row0", "col0", "blob").mapInArrow(run, INDEX)


def _arrow_schema(ddl: str) -> pa.Schema:
    """An Arrow schema from a list of names and types."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def touches(rows: tuple[int, int], cols: tuple[int, int]) -> Column:
    """Whether a block of an index holds pixels of ``rows`` (from, to - 1) and ``cols``."""
    return (F.col("row") < rows[1]) & (F.col("row") + F.col("height") > rows[0]) & (F.col("col") < cols[1]) & (F.col("col") + F.col("width") > cols[0])


def read_window(blobs: DataFrame, found: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """All pixels of a window, as :func:`blobs.decode` gives them, from the bytes of the blocks it touches alone. Bands that repeat the mask of the one before are whole in the index's rows."""
    some = found.filter(touches(rows, cols))
    cut = some.join(blobs.select("tile", "blob"), "tile").withColumn("part", F.expr("substring(blob, cast(begin + 1 as int), cast(length as int))"))
    names = ["tile", "band", "row", "col", "height", "width", "whole", "version", "kind", "error", "tops", "nodata", "valid", "part"]

    def run(batches):
        for b in batches:
            for tile, band, r0, c0, height, width, whole, version, kind, error, tops, nodata, valid, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mask = np.unpackbits(np.frombuffer(valid, np.uint8), count=height * width).reshape(height, width).astype(bool)
                if whole:
                    _, _, z = codec.decode_band(part, 0, mask)
                else:
                    z = np.zeros((height, width, len(tops)), codec.TYPES[kind])
                    z[mask] = _block_values(Cursor(part), kind, version, error, int(mask.sum()), tops).T
                if nodata:
                    z[(z == z.dtype.type(nodata[0])) & mask[:, :, None]] = z.dtype.type(nodata[1])
                i, j = np.meshgrid(np.arange(r0, r0 + height), np.arange(c0, c0 + width), indexing="ij")
                inside = (i >= rows[0]) & (i < rows[1]) & (j >= cols[0]) & (j < cols[1])
                n, depth = int(inside.sum()), z.shape[2]
                if not n:
                    continue
                of = lambda x: np.repeat(x[inside], depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * depth, tile)), pa.array(np.full(n * depth, band)), pa.array(of(i)), pa.array(of(j)), pa.array(np.tile(np.arange(depth), n)), pa.array(z[inside].astype(np.float64).ravel()), pa.array(of(mask)), pa.array([nodata[1] if nodata else None] * (n * depth), pa.float64())],
                    ["tile", "band", "row", "col", "depth", "z", "valid", "nodata"],
                )

    return cut.select(*names).mapInArrow(run, PIXELS)
