"""Encoding pixel relations to blobs and back, as Arrow functions over whole tiles.

Pixels are cut into tiles of a fixed number of rows and columns, so that a task holds single tiles whatever the raster's size; one shuffle
brings a tile's pixels together. Decoding, header and range queries are maps over blobs without any shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blob as codec
from ..functions import oldblob
from ..functions.bits import Corrupt

BLOBS = "tile bigint, row0 bigint, col0 bigint, status int, blob binary"
PIXELS = "tile bigint, band bigint, row bigint, col bigint, depth bigint, z double, valid boolean, nodata double"
#: Rows and columns of a tile.
TILE_ROWS, TILE_COLS = 64, 4096
INFO = "version int, dtype int, n_depth int, n_cols int, n_rows int, n_bands int, n_valid int, blob_size bigint, n_masks int, uses_nodata int, z_min double, z_max double, max_error double, status int"
#: Status codes.
OK, FAILED, WRONG, SMALL, HAS_NAN, HAS_NODATA = range(6)


def _tiles(px: DataFrame, rows: int, cols: int):
    """Pixels with the number of their tile: that of its tile row, for tiles further right plus 2**32 for each."""
    tile = F.floor(F.col("row") / rows).cast("bigint") + F.floor(F.col("col") / cols).cast("bigint") * F.lit(1 << 32)
    return px.select(tile.alias("tile"), "band", "row", "col", "depth", F.coalesce("z", F.lit(0.0)).alias("z"), (F.coalesce("valid", F.lit(False)) & F.col("z").isNotNull()).alias("valid"))


def _raster(tile: int, t: pa.Table, kind: str, rows: int, cols: int):
    """(row0, col0, values, mask) of a tile's pixels."""
    col = {n: t.column(n).to_numpy() for n in ("band", "row", "col", "depth")}
    z, ok = t.column("z").to_numpy(), t.column("valid").to_numpy(zero_copy_only=False).astype(bool)
    row0, col0 = (tile & 0xFFFFFFFF) * rows, (tile >> 32) * cols
    shape = (int(col["band"].max()) + 1, int(col["row"].max()) - row0 + 1, int(col["col"].max()) - col0 + 1, int(col["depth"].max()) + 1)
    dtype = np.dtype(kind)
    values, mask = np.zeros(shape, dtype), np.zeros(shape, bool)
    at = (col["band"], col["row"] - row0, col["col"] - col0, col["depth"])
    with np.errstate(invalid="ignore"):
        values[at] = z.astype(dtype)
    mask[at] = ok & ~(np.isnan(z) & (dtype.kind != "f"))
    return row0, col0, values, mask.all(axis=3)


def encode(px: DataFrame, kind: str, error: float = 0.0, rows: int = TILE_ROWS, version: int = codec.NEWEST, nodata: float | None = None, cols: int = TILE_COLS, strict: bool = False) -> DataFrame:
    """tile, row0, col0, status, blob of every tile of ``rows`` x ``cols`` pixels of ``px`` (band, row, col, depth, z, valid), as type ``kind``.

    Missing pixels and null values are invalid. A tile that can't be encoded (NaN in some depths without a no-data value, a version that lacks
    what is asked for) has a null blob and a status; with ``strict`` it fails the query."""

    def run(key, t):
        tile = key[0].as_py()
        row0, col0, values, mask = _raster(tile, t, kind, rows, cols)
        try:
            data, status = codec.encode(values, mask, error, version, [nodata] * len(values) if nodata is not None else None), OK
        except ValueError as e:
            if strict:
                raise
            data, status = None, HAS_NAN if "NaN" in str(e) else WRONG
        return pa.table({"tile": [tile], "row0": [row0], "col0": [col0], "status": pa.array([status], pa.int32()), "blob": pa.array([data], pa.binary())})

    return _tiles(px, rows, cols).groupBy("tile").applyInArrow(run, BLOBS)


def sizes(px: DataFrame, kind: str, errors=(0.0,), versions=(codec.NEWEST,), rows: int = TILE_ROWS, nodata: float | None = None, cols: int = TILE_COLS) -> DataFrame:
    """tile, error, version, bytes: how large each tile's blob would be with each bound and version, all from one pass over the pixels. Blocks and
    prefix codes are counted, not written. Null bytes where a tile can't be encoded so."""

    def run(key, t):
        tile = key[0].as_py()
        _, _, values, mask = _raster(tile, t, kind, rows, cols)
        out = []
        for e in errors:
            for v in versions:
                try:
                    n = codec.encode(values, mask, e, v, [nodata] * len(values) if nodata is not None else None, size_only=True)
                except ValueError:
                    n = None
                out.append((tile, float(e), v, n))
        return pa.table([pa.array([o[k] for o in out], kind_) for k, kind_ in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int64()))], names=["tile", "error", "version", "bytes"])

    return _tiles(px, rows, cols).groupBy("tile").applyInArrow(run, "tile bigint, error double, version int, bytes bigint")


def tile_modes(px: DataFrame, kind: str, error: float, rows: int = TILE_ROWS, cols: int = TILE_COLS) -> DataFrame:
    """band, depth, bi, bj, n, mode, bytes of every 8x8 block as the writer chooses them, with what their flag byte says."""

    def run(key, t):
        row0, col0, values, mask = _raster(key[0].as_py(), t, kind, rows, cols)
        found = codec.block_modes(values, mask, error)
        names = ("band", "depth", "bi", "bj", "n", "mode", "bytes")
        out = pa.table(dict(zip(names, found, strict=True)))
        return out.set_column(2, "bi", pa.array(found[2] + row0 // codec.MICRO)).set_column(3, "bj", pa.array(found[3] + col0 // codec.MICRO))

    return _tiles(px, rows, cols).groupBy("tile").applyInArrow(run, "band bigint, depth bigint, bi bigint, bj bigint, n bigint, mode string, bytes bigint")


def payloads(blobs: DataFrame) -> DataFrame:
    """tile, band, mode, predictor of each band's blob, from its head: how its values are stored (empty, constant, raw, tiles, delta_codes, codes
    or planes) and, for planes, the predictor (0 none, 1 along rows, 2 along rows and columns)."""

    def run(batches):
        for b in batches:
            for tile, data in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                found = codec.payloads(data)
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([m for m, _ in found], pa.string()), pa.array([p for _, p in found], pa.int64())], ["tile", "band", "mode", "predictor"])

    return blobs.filter("blob is not null").select("tile", "blob").mapInArrow(run, "tile bigint, band bigint, mode string, predictor bigint")


def decode(blobs: DataFrame, bands: int | None = None, strict: bool = True, offset: int = 0, fill: float | None = None) -> DataFrame:
    """All pixels of ``blobs`` (tile, row0, blob, and col0 if it has one), or of the first ``bands`` bands of each; ``nodata`` is the band's value for
    depths without one, null where it has none. The blobs start ``offset`` bytes into the column; invalid pixels have the value ``fill`` (0 by default). A
    damaged blob fails the query, or with ``strict`` off gives no rows."""
    col0 = F.col("col0") if "col0" in blobs.columns else F.lit(0).cast("bigint")

    def run(batches):
        for b in batches:
            for tile, row0, left, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if data is None:
                    continue
                try:
                    r = codec.decode(data[offset:], bands)
                except Corrupt:
                    if strict:
                        raise
                    continue
                shape, n = r.values.shape, r.values.size
                at = np.indices(shape).reshape(4, n)
                valid = np.broadcast_to(r.mask[..., None], shape).reshape(n)
                z = r.values.reshape(n).astype(np.float64)
                if fill is not None:
                    z[~valid] = fill
                nodata = np.array([np.nan if x is None else x for x in r.nodata])[at[0]]
                none = np.array([x is None for x in r.nodata])[at[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tile, np.int64)), pa.array(at[0]), pa.array(at[1] + row0), pa.array(at[2] + left), pa.array(at[3]), pa.array(z), pa.array(valid), pa.array(nodata, mask=none)],
                    ["tile", "band", "row", "col", "depth", "z", "valid", "nodata"],
                )

    return blobs.select("tile", "row0", col0.alias("col0"), "blob").mapInArrow(run, PIXELS)


def info(blob: Column) -> Column:
    """The header struct of a blob; nulls and status 1 for bytes that are none."""

    @F.pandas_udf(INFO)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for data in s:
            try:
                out.append(codec.info(data) | {"status": OK})
            except (Corrupt, TypeError):
                out.append({"status": FAILED})
        return pd.DataFrame(out, columns=[c.split()[0] for c in INFO.split(", ")])

    return run(blob)


def ranges(blobs: DataFrame) -> DataFrame:
    """tile, band, depth, z_min, z_max from headers; blobs whose ranges would hold a no-data value give no rows."""

    def run(batches):
        for b in batches:
            for tile, data in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                try:
                    lo, hi = codec.ranges(data)
                except ValueError:
                    continue
                at = np.indices(lo.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(lo.size, tile, np.int64)), pa.array(at[0]), pa.array(at[1]), pa.array(lo.ravel()), pa.array(hi.ravel())], ["tile", "band", "depth", "z_min", "z_max"])

    return blobs.select("tile", "blob").mapInArrow(run, "tile bigint, band bigint, depth bigint, z_min double, z_max double")


def bands(blobs: DataFrame) -> DataFrame:
    """One row a band blob: tile, band, version, n_valid, size, checksum and whether it holds."""

    def run(batches):
        from ..functions.bits import fletcher32

        for b in batches:
            for tile, data in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                found, at, out = codec.headers(data), 0, []
                for i, h in enumerate(found):
                    good = h.version < 3 or fletcher32(data[at + 14 : at + h.size]) == h.checksum
                    out.append((tile, i, h.version, h.n_valid, h.size, h.checksum, good))
                    at += h.size
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["tile", "band", "version", "n_valid", "size", "checksum", "good"])

    return blobs.select("tile", "blob").mapInArrow(run, "tile bigint, band bigint, version bigint, n_valid bigint, size bigint, checksum bigint, good boolean")


def concat_bands(blobs: DataFrame) -> DataFrame:
    """tile, row0, blob from single-band blobs (tile, row0, band, blob) in order of band."""
    parts = F.array_sort(F.collect_list(F.struct("band", "blob")))
    return blobs.groupBy("tile", "row0").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["blob"])).alias("blob"))


def prune(blobs: DataFrame, low: float, high: float) -> DataFrame:
    """Blobs whose header range meets [low, high]: decoded values lie in it, so no other blob holds one."""
    h = info(F.col("blob"))
    return blobs.withColumn("h", h).filter((F.col("h.status") == OK) & ((F.col("h.z_max") >= low) & (F.col("h.z_min") <= high) | (F.col("h.uses_nodata") == 1))).drop("h")


def decode_old(blobs: DataFrame, kind: str = "<f4") -> DataFrame:
    """Pixels of first-format blobs, rounded half up for integer types."""

    def run(batches):
        for b in batches:
            for tile, row0, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                z, mask = oldblob.decode_old(data)
                z = oldblob.as_type(z, kind)
                at, n = np.indices(z.shape).reshape(4, -1), z.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tile, np.int64)), pa.array(at[0]), pa.array(at[1] + row0), pa.array(at[2]), pa.array(at[3]), pa.array(z.reshape(n).astype(np.float64)), pa.array(np.broadcast_to(mask[..., None], z.shape).reshape(n)), pa.nulls(n, pa.float64())], ["tile", "band", "row", "col", "depth", "z", "valid", "nodata"])

    return blobs.select("tile", "row0", "blob").mapInArrow(run, PIXELS)
