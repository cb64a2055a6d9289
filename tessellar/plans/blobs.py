"""Queries through the blob format: what comes out of a blob is compared with the table that went in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import bits, blob as codec, floats
from ..operators import blobs, masks, statistics, transforms
from ..sources import rasters
from ..sources.rasters import SQL
from .coding import lengths_sql
from .registry import query
from .relational import _cost, on

_ALL = 'band, "row", col, depth, z, valid'
_PX = ["band", "row", "col", "depth", "z", "valid"]


def _trip(px, kind, **options):
    return blobs.decode(blobs.encode(px, kind, **options)).select(*_PX)


@query(on("embed", f"SELECT {_ALL} FROM px"))
def encode_decode_lossless_f32(spark, d):
    return _trip(rasters.embed(spark, d), "<f4")


@query(on("embed4", f"SELECT {_ALL} FROM px"))
def encode_decode_lossless_depth(spark, d):
    return _trip(rasters.embed(spark, d, 4), "<f4")


@query(on("orders", f"SELECT {_ALL} FROM px"))
def encode_decode_lossless_f64(spark, d):
    return _trip(rasters.orders(spark, d), "<f8")


@query(on("psize", f"SELECT {_ALL} FROM px"))
def encode_decode_lossless_u8(spark, d):
    return _trip(rasters.psize(spark, d), "u1")


@query(on("orders", 'SELECT band, "row", col, depth, floor(z) AS z, valid FROM px'))
def encode_decode_lossless_int(spark, d):
    return _trip(rasters.orders(spark, d).withColumn("z", F.floor("z").cast("double")), "<i4")


@query(on("event_bands", 'SELECT band, "row", col, depth, z, valid FROM px WHERE valid'))
def decode_pixels(spark, d):
    return _trip(rasters.event_bands(spark, d), "<f8").filter("valid")


@query(on("embed4", 'SELECT ("row" * 16 + col) * 4 + depth AS bip, depth * (SELECT (max("row") + 1) * 16 FROM px) + "row" * 16 + col AS bsq, z FROM px'))
def decode_interleaved(spark, d):
    """Decoded values with their positions, pixel-interleaved and depth by depth."""
    return transforms.interleave_swap(_trip(rasters.embed(spark, d, 4), "<f4"), 16, 4)


@query(on("psize", 'SELECT band, "row", col, depth, CAST(z AS DOUBLE) AS z FROM px'))
def decode_double(spark, d):
    return _trip(rasters.psize(spark, d), "<u2").select("band", "row", "col", "depth", F.col("z").cast("double").alias("z"))


@query(on("dirty", """SELECT band, "row", col, depth, CASE WHEN isnan(z) THEN -9999.0 ELSE z END AS z, TRUE AS valid FROM
    (SELECT *, count(*) FILTER (NOT isnan(z) AND z <> -9999) OVER (PARTITION BY band, "row", col) AS good FROM px) WHERE good > 0"""))  # fmt: skip
def encode_decode_nodata(spark, d):
    return _trip(rasters.dirty(spark, d), "<f8", nodata=-9999.0).filter("valid")


def _violations(spark, d, version=codec.NEWEST):
    px, e = rasters.events(spark, d), 0.05
    back = blobs.decode(blobs.encode(px, "<f8", error=e, version=version)).select("band", "row", "col", "depth", F.col("z").alias("y"), F.col("valid").alias("ok"))
    j = px.join(back, ["band", "row", "col", "depth"])
    bad = F.col("valid") & (F.abs(F.col("z") - F.col("y")) > e * 1.1)
    return j.groupBy("band").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if(bad).alias("n_violations"), F.count_if(F.col("valid") != F.col("ok")).alias("n_mask_diff"))


_NONE = on("events", "SELECT band, count(*) AS n, count(*) FILTER (valid) AS n_valid, CAST(0 AS BIGINT) AS n_violations, CAST(0 AS BIGINT) AS n_mask_diff FROM px GROUP BY band")


@query(_NONE)
def verify_roundtrip(spark, d):
    return _violations(spark, d)


@query(" UNION ALL ".join(f"SELECT CAST({v} AS BIGINT) AS version, * FROM ({_NONE})" for v in (2, 3, 4, 5, 6)))
def encode_by_version(spark, d):
    out = [_violations(spark, d, v).select(F.lit(v).cast("bigint").alias("version"), "*") for v in (2, 3, 4, 5, 6)]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


_TILE = 'CAST("row" // 64 AS BIGINT) AS tile'


@query(on("embed", f"""SELECT {_TILE}, CAST(6 AS BIGINT) AS version, CAST(6 AS BIGINT) AS dtype, CAST(1 AS BIGINT) AS n_bands, CAST(count(DISTINCT "row") AS BIGINT) AS n_rows, CAST(64 AS BIGINT) AS n_cols, count(*) AS n_valid, min(z) AS z_min, max(z) AS z_max FROM px GROUP BY tile"""))
def blob_info(spark, d):
    h = blobs.encode(rasters.embed(spark, d), "<f4").select("tile", blobs.info(F.col("blob")).alias("h"))
    return h.select("tile", *[F.col(f"h.{c}").cast("bigint").alias(c) for c in ("version", "dtype", "n_bands", "n_rows", "n_cols", "n_valid")], "h.z_min", "h.z_max")


@query(on("embed4", f"SELECT {_TILE}, band, depth, min(z) AS z_min, max(z) AS z_max FROM px GROUP BY ALL"))
def blob_data_ranges(spark, d):
    return blobs.ranges(blobs.encode(rasters.embed(spark, d, 4), "<f4"))


@query(on("events", f"SELECT {_TILE}, CAST(b AS BIGINT) AS band, CAST(6 AS BIGINT) AS version, count(*) FILTER (valid) AS n_valid, TRUE AS good FROM (SELECT band AS b, \"row\", valid FROM ({SQL['event_bands']})) GROUP BY tile, b"))
def blob_scan_bands(spark, d):
    return blobs.bands(blobs.encode(rasters.event_bands(spark, d), "<f8")).select("tile", "band", "version", "n_valid", "good")


@query(on("event_bands", 'SELECT band, "row", col, depth, z FROM px WHERE valid AND band < 1'))
def decode_band_prefix(spark, d):
    return blobs.decode(blobs.encode(rasters.event_bands(spark, d), "<f8"), bands=1).filter("valid").select("band", "row", "col", "depth", "z")


@query(on("event_bands", 'SELECT band, "row", col, depth, z FROM px WHERE valid'))
def multiband_concat(spark, d):
    px = rasters.event_bands(spark, d)
    one = [blobs.encode(px.filter(F.col("band") == b).withColumn("band", F.lit(0).cast("bigint")), "<f8", version=5).withColumn("band", F.lit(b)) for b in (0, 1)]
    return blobs.decode(blobs.concat_bands(one[0].union(one[1]))).filter("valid").select("band", "row", "col", "depth", "z")


@query(on("events", 'SELECT band, "row", col, depth, z FROM px WHERE valid AND z BETWEEN 60 AND 61'))
def pruned_scan(spark, d):
    kept = blobs.prune(blobs.encode(rasters.events(spark, d), "<f8", rows=4), 60.0, 61.0)
    return blobs.decode(kept).filter("valid and z between 60 and 61").select("band", "row", "col", "depth", "z")


@query()
def compressed_size(spark, d):
    """Bytes of each tile at three error bounds, counted without writing them."""
    return blobs.sizes(rasters.events(spark, d), "<f8", (0.0, 0.01, 0.5)).select("tile", "error", "bytes")


@query()
def size_by_version(spark, d):
    return blobs.sizes(rasters.events(spark, d), "<f8", (0.05,), (2, 4, 6)).select("tile", "version", "bytes")


_TILES = "SELECT CAST(count(DISTINCT \"row\" // 64) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_wrong FROM px"


def _size_check(px, kind, **options):
    """How many tiles there are, and of how many the counted size isn't that of the written blob."""
    made = blobs.encode(px, kind, **options).select("tile", F.octet_length("blob").cast("bigint").alias("written"))
    counted = blobs.sizes(px, kind, (options.get("error", 0.0),), (options.get("version", codec.NEWEST),), nodata=options.get("nodata"))
    return made.join(counted, "tile").agg(F.count("*").alias("n"), F.count_if(~F.col("written").eqNullSafe(F.col("bytes"))).alias("n_wrong"))


@query(on("events", _TILES))
def compressed_size_exact(spark, d):
    return _size_check(rasters.events(spark, d), "<f8", error=0.05)


@query(on("events", _TILES))
def size_by_version_exact(spark, d):
    return _size_check(rasters.events(spark, d), "<f8", error=0.05, version=3)


@query(on("dirty", _TILES))
def compressed_size_nodata(spark, d):
    return _size_check(rasters.dirty(spark, d), "<f8", nodata=-9999.0)


@query(on("dirty", f"""SELECT {_TILE}, band, CASE WHEN bool_or(bad = 1) THEN CAST(-9999 AS DOUBLE) END AS nodata FROM
    (SELECT band, "row", col, count(*) FILTER (isnan(z) OR z = -9999) AS bad FROM px GROUP BY ALL) GROUP BY ALL"""))  # fmt: skip
def decode_nodata(spark, d):
    """The no-data value that decoding reports: that of tiles in which some pixel lacks a value in one depth only."""
    return blobs.decode(blobs.encode(rasters.dirty(spark, d), "<f8", nodata=-9999.0)).groupBy("tile", "band").agg(F.max("nodata").alias("nodata"))


@query(on("events", 'SELECT band, "row", col, depth, CASE WHEN valid THEN z ELSE CAST(-1 AS DOUBLE) END AS z, valid FROM px'))
def decode_options(spark, d):
    """Blobs that start three bytes into the column, with a value of the caller's for invalid pixels."""
    made = blobs.encode(rasters.events(spark, d), "<f8", strict=True).withColumn("blob", F.concat(F.lit(b"abc"), "blob"))
    return blobs.decode(made, offset=3, fill=-1.0).select(*_PX)


@query(on("events", _TILES))
def blob_checksum(spark, d):
    """Tiles, and those whose checksum doesn't hold as written or still holds after one bit of the payload has changed."""
    made = blobs.encode(rasters.events(spark, d), "<f8", error=0.05)
    at = F.octet_length("blob") - F.pmod(F.xxhash64("tile"), F.lit(20)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(blob, at, 1)")), 16, 10).cast("int")
    flipped = F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(4))), 2, "0"))
    broken = made.withColumn("at", at).withColumn("blob", F.concat(F.expr("substring(blob, 1, at - 1)"), flipped, F.expr("substring(blob, at + 1)")))
    whole = blobs.bands(made).groupBy("tile").agg(F.bool_and("good").alias("good"))
    after = blobs.bands(broken).groupBy("tile").agg(F.bool_and("good").alias("still"))
    return whole.join(after, "tile").agg(F.count("*").alias("n"), F.count_if(~F.col("good") | F.col("still")).alias("n_wrong"))


@query(on("events", "SELECT * FROM c", _cost(0.05, 8)))
def tile_flags(spark, d):
    """What the writer puts into each block's flag byte, and the block's size, by the byte-level code."""
    return blobs.tile_modes(rasters.events(spark, d), "<f8", 0.05)


@query(on("psize", "SELECT * FROM c", _cost(0.5, 8, 1, "1")))
def tile_flags_u8(spark, d):
    return blobs.tile_modes(rasters.psize(spark, d), "u1", 0.5)


@query(on("events", f"""SELECT {_TILE}, band, CASE WHEN count(*) FILTER (valid) = 0 THEN 'empty' WHEN count(DISTINCT floor(z / 1000)) FILTER (valid) = 1 THEN 'constant' ELSE 'tiles' END AS mode FROM px GROUP BY ALL"""))
def image_mode(spark, d):
    """How each tile's values are stored; thousands of the values, so that some tiles may be constant."""
    px = rasters.events(spark, d).withColumn("z", F.floor(F.col("z") / 1000).cast("double"))
    return blobs.payloads(blobs.encode(px, "<f8", error=0.05)).select("tile", "band", "mode")


@query()
def predictor_choice(spark, d):
    """The predictor of each tile's float planes."""
    return blobs.payloads(blobs.encode(rasters.embed(spark, d), "<f4")).select("tile", "band", "mode", "predictor")


_INTEGERS = [(t.lstrip("<"), int(np.iinfo(t).min), int(np.iinfo(t).max)) for t in codec.TYPES[:6]]


@query(on("byte_bands", f"""SELECT band, dtype, low, high, bool_and(z = floor(z) AND z BETWEEN low AND high) AS fits FROM (SELECT band, z FROM px WHERE valid UNION ALL SELECT band + 10, z FROM px2 WHERE valid),
    (VALUES {', '.join(f"('{t}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for t, a, b in _INTEGERS)}) t(dtype, low, high) GROUP BY ALL""", f"px2 AS ({SQL['int_depths']})"))  # fmt: skip
def type_ranges(spark, d):
    """Which integer types hold all values of each band: one aggregate over the pixels, then the types' ranges beside each band."""
    px = rasters.byte_bands(spark, d).unionByName(rasters.int_depths(spark, d).withColumn("band", F.col("band") + 10))
    r = px.filter("valid").groupBy("band").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.bool_and(F.col("z") == F.floor("z")).alias("whole"))
    types = F.inline(F.array(*[F.struct(F.lit(t).alias("dtype"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for t, a, b in _INTEGERS]))
    return r.select("band", "lo", "hi", "whole", types).select("band", "dtype", "low", "high", (F.col("whole") & (F.col("lo") >= F.col("low")) & (F.col("hi") <= F.col("high"))).alias("fits"))


def _codec_query(column, f):
    """A query that puts a byte column through a codec and back: n rows, how many came back unlike what went in."""

    def run(spark, d):
        rows = spark.read.parquet(f"{d}/{column[0]}.parquet").select(F.coalesce(F.col(column[1]).cast("string"), F.lit("")).cast("binary").alias("x"))
        same = F.pandas_udf(lambda s: s.map(lambda x: f(x)), "boolean")
        return rows.agg(F.count("*").alias("n"), F.count_if(~same("x")).alias("n_wrong"))

    return run


def _zero(table):
    return f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_wrong FROM {table}"


@query(_zero("benchmark"))
def rle_bytes(spark, d):
    return _codec_query(("benchmark", "text"), lambda x: bits.rle_decode(bits.Cursor(bits.rle_encode(x)), len(x)) == x)(spark, d)


@query(_zero("benchmark"))
def packbits(spark, d):
    return _codec_query(("benchmark", "text"), lambda x: bits.packbits_decode(bits.packbits_encode(x), len(x)) == x)(spark, d)


@query(_zero("benchmark"))
def byte_stream_codec(spark, d):
    return _codec_query(("benchmark", "text"), lambda x: not len(x) or floats.decode_plane(floats.encode_plane(np.frombuffer(x, np.uint8)), len(x)).tobytes() == x)(spark, d)


@query(_zero("benchmark"))
def bit_pack(spark, d):
    def same(x):
        v = np.frombuffer(x, np.uint8).astype(np.uint32) * 257
        return bool((bits.unstuff(bits.Cursor(bits.stuff(v)), len(v)) == v).all() and (bits.unstuff(bits.Cursor(bits.stuff(v, 2)), len(v), 2) == v).all())

    return _codec_query(("benchmark", "text"), same)(spark, d)


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_wrong FROM embeddings")
def float_planes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("embedding")

    @F.pandas_udf("boolean")
    def same(s: pd.Series) -> pd.Series:
        return s.map(lambda x: floats.decode(bits.Cursor(floats.encode(np.asarray(x, "<f4").reshape(8, -1))), "<f4", 8, len(x) // 8).tobytes() == np.asarray(x, "<f4").tobytes())

    return e.agg(F.count("*").alias("n"), F.count_if(~same("embedding")).alias("n_wrong"))


@query("WITH RECURSIVE px AS (" + SQL["byte_bands"] + "), h AS (SELECT band, CAST(z AS BIGINT) AS bin, count(*) AS n FROM px WHERE valid GROUP BY ALL), " + lengths_sql("h", "band") + " SELECT band, CAST(sum(n * length) AS BIGINT) AS bits FROM lengths GROUP BY band")
def huffman_lengths(spark, d):
    """Total bits of the codec's prefix code for each 8-bit band's values: one row of counts a band for the codec, whatever the number of pixels."""
    h = statistics.histogram(rasters.byte_bands(spark, d)).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"))

    @F.pandas_udf("bigint")
    def total(column):
        out = []
        for rows in column:
            n = np.zeros(256, np.int64)
            for r in rows:
                n[r["bin"]] = r["n"]
            out.append(int((bits.code_lengths(n) * n).sum()) if (n > 0).sum() > 1 else 0)
        return pd.Series(out)

    return h.select("band", total("h").alias("bits"))


@query(on("psize", 'SELECT "row" AS tile, CAST(0 AS BIGINT) AS band, CAST(0 AS BIGINT) AS "row", col, depth, z, TRUE AS valid FROM px'))
def legacy_decode(spark, d):
    """Every row of the part sizes as a first-format blob (all valid, one raw tile), put together here, and its pixels."""
    import struct

    head = codec.OLD_KEY + struct.pack("<2i", 11, 8)
    rows = rasters.psize(spark, d).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "z"))), lambda x: x["z"]).alias("z"))

    @F.pandas_udf("binary")
    def old(column):
        out = []
        for z in column:
            body = b"\0" + np.asarray(z, "<f4").tobytes()
            out.append(head + struct.pack("<2id", 1, len(z), 0.1) + struct.pack("<3if", 0, 0, 0, 1.0) + struct.pack("<3if", 1, 1, len(body), float(max(z))) + body)
        return pd.Series(out)

    made = rows.select(F.col("row").alias("tile"), F.lit(0).cast("bigint").alias("row0"), old("z").alias("blob"))
    return blobs.decode_old(made).select("tile", "band", "row", "col", "depth", "z", "valid")


@query(on("dirty", "SELECT count(*) FILTER (isnan(z)) AS n_nan FROM px"))
def count_nan(spark, d):
    return masks.has_nan(rasters.dirty(spark, d)).agg(F.sum("n_nan").cast("bigint").alias("n_nan"))


@query()
def blob_source(spark, d):
    """Tiles written as files through the data source and read again with pruning by range."""
    from ..sources.blobs import BlobSource

    spark.dataSource.register(BlobSource)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("this query needs a folder that all executors share: set spark.checkpoint.dir")
    path = f"{root.rstrip('/')}/blobs-{__import__('uuid').uuid4().hex}"
    tiles = blobs.encode(rasters.events(spark, d), "<f8", rows=8).select(F.lit("").alias("path"), F.lit(1).alias("n_bands"), F.lit(0.0).alias("z_min"), F.lit(0.0).alias("z_max"), "blob")
    tiles.write.format("blobs").mode("append").save(path)
    return spark.read.format("blobs").option("low", "0").load(path).select("n_bands", "z_min", "z_max", F.octet_length("blob").cast("bigint").alias("bytes"))
