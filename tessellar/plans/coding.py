"""Queries of the coding steps as relations: prefix codes, sizes, predictors, stuffed bits, runs and checksums, each with SQL that computes the same values."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import blobs, costs, masks, modes, planes, prefix, statistics, streams, transforms, windows
from ..sources import rasters, scan
from .registry import query
from .relational import _blocks, on
from .relational import _cost as cost_sql


# ------------------------------------------------------------------ prefix codes


def lengths_sql(histogram: str, keys: str, name: str = "lengths") -> str:
    """Relations up to ``name`` (keys, bin, n, length) from the relation ``histogram`` (keys, bin, n): the two lightest nodes of each group are merged until one is left, and a
    bin's length is how many merges it takes part in."""
    return f"""{name}_m AS (SELECT {keys}, 0 AS step, list_sort(list({{'n': n, 'inner': 0, 'at': bin, 'bins': [bin]}})) AS nodes, CAST([] AS BIGINT[]) AS bins FROM {histogram} GROUP BY {keys}
        UNION ALL SELECT {keys}, step + 1, list_sort(list_append(nodes[3:], {{'n': nodes[1].n + nodes[2].n, 'inner': 1, 'at': CAST(step AS BIGINT), 'bins': list_concat(nodes[1].bins, nodes[2].bins)}})),
            list_concat(nodes[1].bins, nodes[2].bins) FROM {name}_m WHERE len(nodes) > 1),
    {name}_n AS (SELECT {keys}, bin, count(*) AS length FROM (SELECT {keys}, unnest(bins) AS bin FROM {name}_m) GROUP BY ALL),
    {name} AS (SELECT {keys}, bin, n, coalesce(length, 0) AS length FROM {histogram} LEFT JOIN {name}_n USING ({keys}, bin))"""


_PLANES = f"""WITH RECURSIVE a AS ({rasters.SQL["psize"]}), b AS ({rasters.SQL["orders"]}),
    h AS (SELECT 'psize' AS raster, band, CAST(0 AS BIGINT) AS plane, CAST(z AS BIGINT) % 256 AS bin, count(*) AS n FROM a GROUP BY ALL
        UNION ALL SELECT 'orders', band, CAST(k AS BIGINT), (CAST(floor(z) AS BIGINT) >> CAST(8 * k AS INT)) & 255, count(*) FROM b, range(4) t(k) GROUP BY ALL),
    {lengths_sql("h", "raster, band, plane")}"""
_KEYS = ["raster", "band", "plane"]


def _plane_histograms(spark, d):
    small = statistics.histogram(rasters.psize(spark, d)).select(F.lit("psize").alias("raster"), "band", F.lit(0).cast("bigint").alias("plane"), "bin", "n")
    wide = statistics.byte_histogram(rasters.orders(spark, d).withColumn("z", F.floor("z").cast("double")))
    return small.unionByName(wide.select(F.lit("orders").alias("raster"), "band", "plane", F.col("byte").alias("bin"), "n"))


@query(_PLANES + """, l AS (SELECT *, max(length) OVER (PARTITION BY raster, band, plane) AS longest FROM lengths),
    c AS (SELECT *, coalesce(sum(pow(2, -length)) OVER (PARTITION BY raster, band, plane ORDER BY length DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM l)
    SELECT raster, band, plane, bin, n, length, CASE WHEN longest BETWEEN 1 AND 32 THEN CAST(low * pow(2, length) AS BIGINT) END AS code FROM c""")  # fmt: skip
def prefix_codes(spark, d):
    return prefix.canonical_codes(prefix.code_lengths(_plane_histograms(spark, d), _KEYS), _KEYS)


@query(_PLANES + """SELECT raster, band, plane, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n_values, max(length) AS longest, CAST(sum(n * length) AS BIGINT) AS bits,
    round(sum(n * log2(t / n)), 3) AS entropy_bits, CAST(sum(pow(2, 32 - length)) AS BIGINT) AS kraft FROM (SELECT *, sum(n) OVER (PARTITION BY raster, band, plane) AS t FROM lengths) GROUP BY raster, band, plane""")  # fmt: skip
def prefix_code_totals(spark, d):
    return prefix.code_totals(prefix.code_lengths(_plane_histograms(spark, d), _KEYS), _KEYS)


def _delta_sql(px: str) -> str:
    """The 8-bit prediction of ``px``: left, else above, else the last valid value before."""
    return f"""SELECT band, ((CAST(z - coalesce(CASE WHEN lv THEN l END, CASE WHEN av THEN a END, p, 0) AS BIGINT) % 256) + 256) % 256 AS bin, count(*) AS n FROM (
    SELECT *, lag(z) OVER r AS l, lag(valid) OVER r AS lv, lag(z) OVER c AS a, lag(valid) OVER c AS av, last_value(CASE WHEN valid THEN z END IGNORE NULLS) OVER (PARTITION BY band ORDER BY "row", col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
    FROM {px} WINDOW r AS (PARTITION BY band, "row" ORDER BY col), c AS (PARTITION BY band, col ORDER BY "row")) WHERE valid GROUP BY ALL"""


def _coded_sql(lengths: str, name: str, keys: str = "band") -> str:
    """The relation ``name`` (keys, n_bins, stretch, longest, bytes) from lengths: the stretch leaves out the longest row of unused bins, first to last or round the end."""
    width = "CAST(floor(log2(longest)) AS BIGINT) + 1"
    return f"""{name}_g AS (SELECT {keys}, bin, n, length, coalesce(lead(bin) OVER (PARTITION BY {keys} ORDER BY bin), min(bin) OVER (PARTITION BY {keys}) + 256) AS nxt FROM {lengths}),
    {name}_s AS (SELECT {keys}, count(*) AS n_bins, 257 - max(nxt - bin) AS stretch, max(length) AS longest, sum(length) AS cb, sum(n * length) AS vb FROM {name}_g GROUP BY {keys}),
    {name} AS (SELECT {keys}, n_bins, stretch, longest, CASE WHEN n_bins > 1 AND longest <= 32 THEN CAST(16 + 1 + (CASE WHEN stretch < 256 THEN 1 ELSE 2 END) + (stretch * ({width}) + 7) // 8 + 4 * ((cb + 31) // 32) + 4 * ((vb + 31) // 32) + 4 AS BIGINT) END AS bytes FROM {name}_s)"""


def coded_sql(px: str) -> str:
    """Relations up to ``coded`` (band, value_bytes, delta_bytes, choice, bytes) from the 8-bit raster ``px``."""
    return f"""vh AS (SELECT band, CAST(z AS BIGINT) AS bin, count(*) AS n FROM {px} WHERE valid GROUP BY ALL), dh AS ({_delta_sql(px)}),
    {lengths_sql("vh", "band", "vl")}, {lengths_sql("dh", "band", "dl")}, {_coded_sql("vl", "vc")}, {_coded_sql("dl", "dc")},
    coded AS (SELECT band, v.bytes AS value_bytes, d.bytes AS delta_bytes, CASE WHEN v.bytes <= coalesce(d.bytes, v.bytes) THEN 'value' WHEN d.bytes IS NOT NULL THEN 'delta' END AS choice, least(v.bytes, d.bytes) AS bytes FROM vc v JOIN dc d USING (band))"""


@query("WITH RECURSIVE px AS (" + rasters.SQL["byte_bands"] + "), " + coded_sql("px") + " SELECT * FROM coded")
def coded_value_or_delta(spark, d):
    px = rasters.byte_bands(spark, d)
    return prefix.value_or_delta(statistics.histogram(px), statistics.delta_histogram(px), ["band"])


# ------------------------------------------------------------------ float fields, predictors, levels


def _fields_sql(kind: str) -> str:
    """Relations up to d (band, row, col, width, height, u0, u1, u2) from px, by the bits of the values."""
    m, high = (23, 511) if kind == "float" else (52, 4095)
    low = (1 << m) - 1
    if kind == "float":
        bits = "(SELECT *, CAST(CAST(CAST(z AS FLOAT) AS BIT) AS UINTEGER)::BIGINT AS x FROM px)"
        fields = f"SELECT *, ((x >> 23) & 255) * 2 + (x >> 31) AS hi, x & {low} AS lo FROM {bits}"
    else:
        fields = f"SELECT *, CAST(x >> 52 AS BIGINT) AS hi, CAST(x & {low}::UBIGINT AS BIGINT) AS lo FROM (SELECT *, CAST(CAST(z AS BIT) AS UBIGINT) AS x FROM px)"
    less = lambda c, p: f"({c} - coalesce({p}, 0)) & {high if c.startswith('hi') else low}"
    rows, cols = 'OVER (PARTITION BY band, "row" ORDER BY col)', 'OVER (PARTITION BY band, col ORDER BY "row")'
    pack = lambda e: f"CAST(CASE WHEN hi{e} >= 2048 THEN hi{e} - 4096 ELSE hi{e} END AS BIGINT) * {1 << m} + lo{e}" if kind == "double" else f"hi{e} * {1 << m} + lo{e}"
    return f"""f AS ({fields}), f1 AS (SELECT *, {less("hi", f"lag(hi) {rows}")} AS hi1, {less("lo", f"lag(lo) {rows}")} AS lo1 FROM f),
    f2 AS (SELECT *, {less("hi1", f"lag(hi1) {cols}")} AS hi2, {less("lo1", f"lag(lo1) {cols}")} AS lo2, max("row") OVER (PARTITION BY band) + 1 AS height, max(col) OVER (PARTITION BY band) + 1 AS width FROM f1),
    d AS (SELECT band, "row", col, depth, height, width, hi, lo, hi1, lo1, hi2, lo2, {pack("")} AS u0, {pack("1")} AS u1, {pack("2")} AS u2 FROM f2)"""


_D = 'SELECT band, "row", col, depth, hi, lo, hi1, lo1, hi2, lo2, u0, u1, u2 FROM d'


@query(on("float_bands", _D, _fields_sql("float")))
def float_field_differences(spark, d):
    return planes.field_differences(rasters.float_bands(spark, d), "float")


@query(on("double_bands", _D, _fields_sql("double")))
def double_field_differences(spark, d):
    return planes.field_differences(rasters.double_bands(spark, d), "double")


@query(on("double_bands", 'SELECT band, "row", col, depth, z FROM px'))
def double_fields_restored(spark, d):
    return planes.restored(planes.field_differences(rasters.double_bands(spark, d), "double"), "double")


@query(on("float_bands", 'SELECT band, "row", col, depth, z FROM px'))
def float_fields_restored(spark, d):
    return planes.restored(planes.field_differences(rasters.float_bands(spark, d), "float"), "float")


_SHAPE = "m AS (SELECT DISTINCT band, height, width FROM d)"
_SPREAD = """CAST(trunc(greatest(0::FLOAT, mg + (2::FLOAT * mg + CAST({length} AS FLOAT)) * CAST(i AS FLOAT))) AS BIGINT)"""
#: s: the stripes (band, part, begin_, end_) on which predictors are tried.
_STRIPES = f"""s0 AS (SELECT *, greatest(4, 8192 // width) AS nr FROM m),
    s1 AS (SELECT *, greatest(1, least(CAST(round(sqrt(round(height * width / 8192.0::DOUBLE) + 1)) AS BIGINT), height // nr)) AS n FROM s0),
    s2 AS (SELECT *, CAST((height - n * nr) / (2.0::DOUBLE * n) AS FLOAT) AS mg, unnest(range(n)) AS i FROM s1),
    s3 AS (SELECT *, {_SPREAD.format(length="nr")} AS top FROM s2),
    s AS (SELECT band, i AS part, top * width AS begin_, least(top + nr, height) * width AS end_ FROM s3)"""
#: t: those of byte planes.
_SNIPPETS = f"""t1 AS (SELECT *, least(CAST(round(sqrt(round(height * width / 8192.0::DOUBLE) + 1)) AS BIGINT), height * width // 8192) AS n FROM m),
    t2 AS (SELECT *, CAST((height * width - n * 8192) / (2.0::DOUBLE * n) AS FLOAT) AS mg, unnest(range(n)) AS i FROM t1 WHERE n > 0),
    t AS (SELECT band, i AS part, {_SPREAD.format(length="8192")} AS begin_, least({_SPREAD.format(length="8192")} + 8192, height * width) AS end_ FROM t2)"""


def _predictors_sql(size: int) -> str:
    at = "(({u} >> CAST(8 * k AS INT)) & 255)"
    return f"""{_SHAPE}, {_STRIPES},
    v AS (SELECT d.band, part, "row" * width + col - begin_ AS p, unnest([0, 1, 2]) AS predictor, unnest([u0, u1, u2]) AS u FROM d JOIN s ON s.band = d.band AND "row" * width + col >= begin_ AND "row" * width + col < end_),
    w AS (SELECT *, lag(u) OVER (PARTITION BY band, part, predictor ORDER BY p) AS b FROM v),
    x AS (SELECT band, part, predictor, k, less, CASE WHEN less = 1 AND p > 0 THEN ({at.format(u="u")} - {at.format(u="b")}) & 255 ELSE {at.format(u="u")} END AS byte, count(*) AS n FROM w, range({size}) k(k), range(2) l(less) WHERE p % 7 = 0 GROUP BY ALL),
    y AS (SELECT band, part, predictor, k, less, floor((round(sum(n * log2(t / n)), 6) + 7) / 8) AS bytes FROM (SELECT *, sum(n) OVER (PARTITION BY band, part, predictor, k, less) AS t FROM x) GROUP BY ALL),
    z AS (SELECT band, predictor, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT band, part, predictor, k, min(bytes) AS bytes FROM y GROUP BY ALL) GROUP BY ALL),
    pr AS (SELECT band, max(bytes) FILTER (predictor = 0) AS as_is, max(bytes) FILTER (predictor = 1) AS along_rows, max(bytes) FILTER (predictor = 2) AS along_both, CAST(min_by(predictor, (bytes, predictor)) AS BIGINT) AS predictor FROM z GROUP BY band)"""


@query(on("float_bands", "SELECT * FROM pr", _fields_sql("float") + ", " + _predictors_sql(4)))
def predictor_by_stripes(spark, d):
    return planes.predictors(rasters.float_bands(spark, d), "float")


@query(on("double_bands", "SELECT * FROM pr", _fields_sql("double") + ", " + _predictors_sql(8)))
def predictor_by_stripes_double(spark, d):
    return planes.predictors(rasters.double_bands(spark, d), "double")


def _levels_sql(size: int) -> str:
    """One level's bytes from those of the level below, as lags of lags."""
    level = lambda k: f"l{k} AS (SELECT band, part, p, plane, predictor, CASE WHEN p >= {k} THEN (byte - lag(byte) OVER q) & 255 ELSE byte END AS byte FROM l{k - 1} WINDOW q AS (PARTITION BY band, part, plane ORDER BY p))"
    return f"""{_predictors_sql(size)}, {_SNIPPETS},
    l0 AS (SELECT d.band, part, "row" * width + col - begin_ AS p, k AS plane, predictor, (([u0, u1, u2])[predictor + 1] >> CAST(8 * k AS INT)) & 255 AS byte FROM d JOIN t ON t.band = d.band AND "row" * width + col >= begin_ AND "row" * width + col < end_ JOIN pr ON pr.band = d.band, range({size}) k(k)),
    {", ".join(level(k) for k in range(1, 6))},
    lv AS ({" UNION ALL ".join(f"SELECT band, part, plane, {k} AS level, byte, count(*) AS n FROM l{k} WHERE p % 7 = 0 AND {k} <= 5 - predictor GROUP BY ALL" for k in range(6))}),
    lc AS (SELECT band, plane, level, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT band, part, plane, level, floor((round(sum(n * log2(t / n)), 6) + 7) / 8) AS bytes FROM (SELECT *, sum(n) OVER (PARTITION BY band, part, plane, level) AS t FROM lv) GROUP BY ALL) GROUP BY ALL),
    la AS (SELECT band, predictor, CAST(k AS BIGINT) AS plane, CAST(coalesce(level, 0) AS BIGINT) AS level, coalesce(bytes, 0) AS bytes FROM (SELECT band, predictor, k FROM pr, range({size}) k(k)) LEFT JOIN (SELECT band, plane AS k, level, bytes FROM lc) USING (band, k)),
    lb AS (SELECT *, coalesce(lead(bytes) OVER (PARTITION BY band, plane ORDER BY level) >= bytes, TRUE) AS stop FROM la),
    ls AS (SELECT band, predictor, plane, level, bytes, min(level) FILTER (stop) OVER (PARTITION BY band, plane) AS best FROM lb)"""


@query(on("float_bands", "SELECT * FROM ls", _fields_sql("float") + ", " + _levels_sql(4)))
def plane_delta_levels(spark, d):
    return planes.plane_levels(rasters.float_bands(spark, d), "float")


@query(on("double_bands", "SELECT * FROM ls", _fields_sql("double") + ", " + _levels_sql(8)))
def plane_delta_levels_double(spark, d):
    return planes.plane_levels(rasters.double_bands(spark, d), "double")


# ------------------------------------------------------------------ mode of a whole band


def _sum_costs(error: float, size: int, raw: int, offset: str | None, px: str, into: str) -> str:
    return f'{into} AS (WITH px AS (SELECT * FROM {px}), {cost_sql(error, size, raw, offset)} SELECT band, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY band)'


def _modes_sql(px: str, raw: int, codes: bool, floats: bool, tiles: str, more: str = "") -> str:
    """The modes of px, from relations t8, t16 (band, bytes), coded and, for floats, pl (band, bytes)."""
    flag = int(codes or floats)
    null = "CAST(NULL AS BIGINT)"
    return f"""{more}{tiles},
    sh AS (SELECT band, max("row") + 1 AS height, max(col) + 1 AS width, max(depth) + 1 AS depths, count(*) FILTER (valid) AS n, min(z) FILTER (valid) AS a, max(z) FILTER (valid) AS b FROM {px} GROUP BY band),
    k1 AS (SELECT sh.*, n * {raw} AS raw, t8.bytes AS bytes_8, t16.bytes AS bytes_16, {"c.value_bytes, c.delta_bytes, c.choice, c.bytes" if codes else f"{null} AS value_bytes, {null} AS delta_bytes, CAST(NULL AS VARCHAR) AS choice, {null}"} AS coded, {"pl.bytes" if floats else null} AS planes_bytes
        FROM sh LEFT JOIN t8 USING (band) LEFT JOIN t16 USING (band) {"LEFT JOIN coded c USING (band)" if codes else ""} {"LEFT JOIN pl USING (band)" if floats else ""}),
    k2 AS (SELECT *, CASE WHEN coded < bytes_8 THEN choice WHEN planes_bytes < CAST(0.9 AS DOUBLE) * bytes_8 THEN 'planes' ELSE 'tiles 8' END AS m1, CASE WHEN coded < bytes_8 THEN coded WHEN planes_bytes < CAST(0.9 AS DOUBLE) * bytes_8 THEN planes_bytes ELSE bytes_8 END AS b1 FROM k1),
    k3 AS (SELECT *, bytes_8 * 8 < height * width * depths * 1.5 AND bytes_8 < 4 * raw AND coalesce(bytes_8 < 2 * coalesce(coded, planes_bytes), TRUE) AND (height > 8 OR width > 8) AND bytes_16 <= b1 AS wide FROM k2),
    k4 AS (SELECT *, CASE WHEN wide THEN 'tiles 16' ELSE m1 END AS m2, CASE WHEN wide THEN bytes_16 ELSE b1 END + {flag} AS b2 FROM k3)
    SELECT band, n, bytes_8, bytes_16, value_bytes, delta_bytes, planes_bytes, raw AS raw_bytes, CASE WHEN n = 0 THEN 'empty' WHEN a = b THEN 'constant' WHEN raw <= b2 THEN 'raw' ELSE m2 END AS mode,
        CAST(CASE WHEN n = 0 OR a = b THEN 0 WHEN raw <= b2 THEN raw ELSE b2 END AS BIGINT) AS bytes FROM k4"""


@query("WITH RECURSIVE px AS (" + rasters.SQL["flat_bands"] + "), " + _modes_sql("px", 1, True, False, _sum_costs(0.5, 8, 1, "1", "px", "t8") + ", " + _sum_costs(0.5, 16, 1, "1", "px", "t16"), coded_sql("px") + ", "))
def image_mode_bytes(spark, d):
    return modes.image_modes(rasters.flat_bands(spark, d), "uchar", 0.5)


#: Without loss a block of floats is zero, constant or raw.
_FLOAT_TILES = ", ".join(f"""t{s} AS (SELECT band, CAST(sum(CASE WHEN lo = 0 AND hi = 0 THEN 1 WHEN lo = hi THEN least(1 + o, 1 + 4 * n) ELSE 1 + 4 * n END) AS BIGINT) AS bytes FROM (
    SELECT band, depth, "row" // {s} AS bi, col // {s} AS bj, count(*) AS n, min(z) AS lo, max(z) AS hi, CASE WHEN min(z) = floor(min(z)) AND min(z) BETWEEN 0 AND 255 THEN 1 WHEN min(z) = floor(min(z)) AND min(z) BETWEEN -32768 AND 32767 THEN 2 ELSE 4 END AS o FROM px GROUP BY ALL) GROUP BY band)""" for s in (8, 16))  # fmt: skip
_PL = ", ct AS (SELECT band, sum((end_ - begin_ - 1) // 7 + 1) AS counted FROM s GROUP BY band), pl AS (SELECT band, CAST(1 + 24 + ceil(least(as_is, along_rows, along_both) * height * width / CAST(counted AS DOUBLE)) AS BIGINT) AS bytes FROM pr JOIN ct USING (band) JOIN m USING (band)), "


@query("WITH px AS (" + rasters.SQL["float_bands"] + "), " + _modes_sql("px", 4, False, True, _FLOAT_TILES, _fields_sql("float") + ", " + _predictors_sql(4) + _PL))
def image_mode_floats(spark, d):
    return modes.image_modes(rasters.float_bands(spark, d), "float", 0.0)


@query("WITH px AS (" + rasters.SQL["event_bands"] + "), " + _modes_sql("px", 8, False, False, _sum_costs(0.05, 8, 8, None, "px", "t8") + ", " + _sum_costs(0.05, 16, 8, None, "px", "t16")))
def image_mode_lossy(spark, d):
    return modes.image_modes(rasters.event_bands(spark, d), "double", 0.05)


@query("WITH px AS (" + rasters.SQL["event_bands"] + "), " + _modes_sql("px", 8, False, False, _sum_costs(10.0, 8, 8, None, "px", "t8") + ", " + _sum_costs(10.0, 16, 8, None, "px", "t16")))
def image_mode_coarse(spark, d):
    return modes.image_modes(rasters.event_bands(spark, d), "double", 10.0)


# ------------------------------------------------------------------ differences between depths


_INT = "CASE WHEN lo BETWEEN 0 AND 255 THEN 1 WHEN lo BETWEEN -32768 AND 65535 THEN 2 ELSE 4 END"


@query("WITH src AS (" + rasters.SQL["int_depths"] + f"""), sa AS (WITH px AS (SELECT * FROM src), {cost_sql(0.5, 8, 4, _INT)} SELECT *, FALSE AS differs FROM c),
    sd AS (WITH x AS (SELECT *, z - lag(z) OVER (PARTITION BY band, "row", col ORDER BY depth) AS d FROM src WHERE valid),
        y AS (SELECT band, "row", col, depth, d AS z, valid, bool_and(d BETWEEN -2147483648 AND 2147483647) OVER (PARTITION BY band, depth, "row" // 8, col // 8) AS fits FROM x WHERE d IS NOT NULL),
        px AS (SELECT * FROM y WHERE fits), {cost_sql(0.5, 8, 4, _INT, "0")} SELECT *, TRUE AS differs FROM c)
    SELECT band, depth, bi, bj, n, mode, differs, bytes FROM (SELECT * FROM sa UNION ALL SELECT * FROM sd) QUALIFY row_number() OVER (PARTITION BY band, depth, bi, bj ORDER BY bytes, differs) = 1""")  # fmt: skip
def depth_block_modes(spark, d):
    return costs.depth_costs(rasters.int_depths(spark, d), "int")


# ------------------------------------------------------------------ stuffed bits


_PLACED = "band, depth, bi, bj, CAST(row_number() OVER (PARTITION BY band, depth, bi, bj ORDER BY \"row\", col) - 1 AS BIGINT) AS i, q"


def _quanta(spark, d):
    """Quanta of the masked part sizes, numbered in scan order within their block."""
    q = transforms.quantize(rasters.psize(spark, d, True), 0.5)
    w = W.partitionBy(*statistics.BLOCK).orderBy("row", "col")
    return q.select(*statistics.BLOCK, (F.row_number().over(w) - 1).cast("bigint").alias("i"), "q")


def _stuffed_sql(old: bool) -> str:
    """Bit by bit: where each bit of each value goes."""
    place = "CASE WHEN {old} THEN 31 - o % 32 - {spare} ELSE o % 32 END".format(old=old, spare="CASE WHEN o // 32 = (need - 1) // 4 THEN 8 * ((4 - need % 4) % 4) ELSE 0 END")
    bit = "(q >> CAST(bits - 1 - k AS INT)) & 1" if old else "(q >> CAST(k AS INT)) & 1"
    return f"""SELECT band, depth, bi, bj, n, bits, o // 32 AS word, CAST(sum(CASE WHEN ({bit}) = 1 THEN 1::BIGINT << CAST({place} AS INT) ELSE 0 END) AS BIGINT) AS value FROM
    (SELECT *, i * bits + k AS o, (n * bits + 7) // 8 AS need FROM (SELECT *, unnest(range(bits)) AS k FROM
    (SELECT *, count(*) OVER (PARTITION BY band, depth, bi, bj) AS n, CASE WHEN max(q) OVER (PARTITION BY band, depth, bi, bj) > 0 THEN CAST(floor(log2(max(q) OVER (PARTITION BY band, depth, bi, bj))) AS BIGINT) + 1 ELSE 0 END AS bits FROM (SELECT {_PLACED} FROM q)))) GROUP BY ALL"""


@query(on("psize_masked", _stuffed_sql(False), _blocks(0.5)))
def stuffed_words(spark, d):
    return streams.stuffed_words(_quanta(spark, d), statistics.BLOCK)


@query(on("psize_masked", _stuffed_sql(True), _blocks(0.5)))
def stuffed_words_old(spark, d):
    return streams.stuffed_words(_quanta(spark, d), statistics.BLOCK, old=True)


_SOME = f"SELECT band, depth, bi, bj, i, q FROM (SELECT {_PLACED}, max(q) OVER (PARTITION BY band, depth, bi, bj) AS m FROM q) WHERE m > 0"


@query(on("psize_masked", _SOME, _blocks(0.5)))
def unstuffed_quanta(spark, d):
    return streams.unstuffed(streams.stuffed_words(_quanta(spark, d), statistics.BLOCK), statistics.BLOCK)


@query(on("psize_masked", _SOME, _blocks(0.5)))
def unstuffed_quanta_old(spark, d):
    return streams.unstuffed(streams.stuffed_words(_quanta(spark, d), statistics.BLOCK, old=True), statistics.BLOCK, old=True)


# ------------------------------------------------------------------ runs


def _segments_sql(stream: str, keys: str, least: int, most: int, literal: int, repeat_bytes: int, head: int) -> str:
    """Relations up to seg (keys, start, length, byte, bytes) from ``stream`` (keys, pos, byte): a repeat or a literal for each position first, then islands of these."""
    return f"""r0 AS (SELECT *, CASE WHEN byte = lag(byte) OVER (PARTITION BY {keys} ORDER BY pos) THEN 0 ELSE 1 END AS new FROM {stream}),
    r1 AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY pos) AS run FROM r0),
    r2 AS (SELECT *, count(*) OVER (PARTITION BY {keys}, run) AS n, row_number() OVER (PARTITION BY {keys}, run ORDER BY pos) - 1 AS j FROM r1),
    r3 AS (SELECT *, n >= {least} AND (j < n - n % {most} OR n % {most} >= {least}) AS again FROM r2),
    r4 AS (SELECT *, CASE WHEN again THEN run ELSE -sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY pos) - 1 END AS island FROM r3),
    r5 AS (SELECT *, (row_number() OVER (PARTITION BY {keys}, again, island ORDER BY pos) - 1) // CASE WHEN again THEN {most} ELSE {literal} END AS piece FROM r4),
    seg AS (SELECT {keys}, min(pos) AS start, count(*) AS length, CASE WHEN again THEN min(byte) END AS byte, CASE WHEN again THEN {repeat_bytes} ELSE count(*) + {head} END AS bytes FROM r5 GROUP BY {keys}, again, island, piece)"""


_RLE, _PACK = (5, 32767, 32767, 3, 2), (2, 129, 128, 2, 1)
_MASK = """m AS (SELECT band, CAST(("row" * 100 + col) // 8 AS BIGINT) AS pos, CAST(sum(CASE WHEN valid THEN 128 >> CAST(("row" * 100 + col) % 8 AS INT) ELSE 0 END) AS BIGINT) AS byte FROM px GROUP BY ALL)"""
_MASKS = rasters.SQL["event_bands"] + ' UNION ALL SELECT CAST(2 AS BIGINT), "row", col, depth, z, "row" % 7 > 2 FROM (' + rasters.SQL["events"] + ")"


def _mask_streams(spark, d):
    more = rasters.events(spark, d).withColumn("band", F.lit(2).cast("bigint")).withColumn("valid", F.col("row") % 7 > 2)
    return masks.pack_mask(rasters.event_bands(spark, d).unionByName(more), 100).withColumnRenamed("byte_pos", "pos")


@query(f"WITH px AS ({_MASKS}), {_MASK}, {_segments_sql('m', 'band', *_RLE)} SELECT * FROM seg")
def mask_run_segments(spark, d):
    return streams.rle_segments(_mask_streams(spark, d), ["band"])


@query(f"WITH px AS ({_MASKS}), {_MASK}, {_segments_sql('m', 'band', *_RLE)} SELECT band, count(byte) AS n_repeats, count(*) FILTER (byte IS NULL) AS n_literals, CAST(sum(bytes) + 2 AS BIGINT) AS bytes FROM seg GROUP BY band")
def mask_run_bytes(spark, d):
    return streams.coded_size(streams.rle_segments(_mask_streams(spark, d), ["band"]), ["band"], end=2)


_BYTE_STREAMS = """b AS (SELECT band, CAST(k AS BIGINT) AS plane, "row" * 100 + col AS pos, (CAST(floor(z / 1000) AS BIGINT) >> CAST(8 * k AS INT)) & 255 AS byte FROM px, range(4) t(k))"""
_P_KEYS = ["band", "plane"]


def _plane_streams(spark, d):
    planes_ = transforms.byte_planes(rasters.orders(spark, d).withColumn("z", F.floor(F.col("z") / 1000).cast("double")))
    return planes_.select("band", "plane", (F.col("row") * 100 + F.col("col")).alias("pos"), F.col("byte").cast("bigint").alias("byte"))


@query(on("orders", "SELECT * FROM seg", _BYTE_STREAMS + ", " + _segments_sql("b", "band, plane", *_PACK)))
def plane_packbits_segments(spark, d):
    return streams.packbits_segments(_plane_streams(spark, d), _P_KEYS)


@query(on("orders", "SELECT band, plane, count(byte) AS n_repeats, count(*) FILTER (byte IS NULL) AS n_literals, CAST(sum(bytes) AS BIGINT) AS bytes FROM seg GROUP BY band, plane", _BYTE_STREAMS + ", " + _segments_sql("b", "band, plane", *_PACK)))
def plane_packbits_bytes(spark, d):
    return streams.coded_size(streams.packbits_segments(_plane_streams(spark, d), _P_KEYS), _P_KEYS)


# ------------------------------------------------------------------ checksum


@query("""SELECT doc_id, CASE WHEN t = 0 THEN 65535 ELSE t END * 65536 + CASE WHEN s = 0 THEN 65535 ELSE s END AS checksum FROM (SELECT doc_id, CAST(coalesce(sum(w), 0) % 65535 AS BIGINT) AS s, CAST(coalesce(sum((n - i) * w), 0) % 65535 AS BIGINT) AS t FROM
    (SELECT doc_id, n, i, CAST('0x' || rpad(substr(h, 4 * i + 1, 4), 4, '0') AS BIGINT) AS w FROM (SELECT doc_id, hex(encode(text)) AS h, (strlen(text) + 1) // 2 AS n, unnest(range((strlen(text) + 1) // 2)) AS i FROM documents WHERE text <> '')) GROUP BY doc_id)
    UNION ALL SELECT doc_id, 4294967295 FROM documents WHERE text = ''""")  # fmt: skip
def text_checksums(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null")
    return streams.fletcher32(docs.select("doc_id", F.encode("text", "utf-8").alias("data")), ["doc_id"])


@query(f'SELECT DISTINCT CAST("row" // 64 AS BIGINT) AS tile, TRUE AS same FROM ({rasters.SQL["orders"]})')
def tile_checksums(spark, d):
    made = blobs.encode(rasters.orders(spark, d), "<f8", error=0.01)
    # bytes 10 to 13 of the header, lowest first
    stored = F.conv(F.concat(*[F.hex(F.substring("blob", k, 1)) for k in (14, 13, 12, 11)]), 16, 10).cast("bigint")
    return streams.fletcher32(made, ["tile"], "blob", skip=14).join(made.select("tile", stored.alias("stored")), "tile").select("tile", (F.col("checksum") == F.col("stored")).alias("same"))


# ------------------------------------------------------------------ files and windows


def _shared(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("this query needs a folder that all executors share: set spark.checkpoint.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(on("events", """SELECT 'ok' AS status, CAST(count(DISTINCT "row") AS BIGINT) AS n_rows, max(col) + 1 AS n_cols, count(*) FILTER (valid) AS n_valid, min(z) FILTER (valid) AS z_min, max(z) FILTER (valid) AS z_max FROM px GROUP BY "row" // 8"""))
def blob_scan_splits(spark, d):
    """Tiles of events written one behind the other by Spark, and read again in splits."""
    path = _shared(spark, "scan")
    scan.write(blobs.encode(rasters.events(spark, d), "<f8", rows=8), path)
    return scan.scan(spark, path).select("status", "n_rows", "n_cols", "n_valid", "z_min", "z_max")


_ROWS, _COLS = (5, 75), (21, 60)
_WINDOW = f'"row" >= {_ROWS[0]} AND "row" < {_ROWS[1]} AND col >= {_COLS[0]} AND col < {_COLS[1]}'


def _whole_orders(spark, d):
    return blobs.encode(rasters.orders(spark, d).withColumn("z", F.floor("z").cast("double")), "<i4")


@query(on("orders", f'SELECT band, "row", col, depth, floor(z) AS z, valid FROM px WHERE {_WINDOW}'))
def window_pixels(spark, d):
    made = _whole_orders(spark, d)
    return windows.read_window(made, windows.index(made), _ROWS, _COLS).select("band", "row", "col", "depth", "z", "valid")


@query(on("int_depths", f'SELECT band, "row", col, depth, CASE WHEN valid THEN z ELSE 0 END AS z, valid FROM px WHERE {_WINDOW}'))
def window_pixels_depths(spark, d):
    made = blobs.encode(rasters.int_depths(spark, d), "<i4")
    return windows.read_window(made, windows.index(made), _ROWS, _COLS).select("band", "row", "col", "depth", "z", "valid")


@query(on("orders", f"""SELECT count(*) AS n_blocks, count(*) FILTER (hit) AS n_read, TRUE AS fewer_bytes FROM (SELECT bool_or({_WINDOW}) AS hit FROM px GROUP BY "row" // 8, col // 8)"""))
def window_blocks(spark, d):
    """Blocks of 8 x 8 in the index, those a window reads, and whether their bytes are as much fewer as their number is."""
    found = windows.index(_whole_orders(spark, d))
    hit = windows.touches(_ROWS, _COLS)
    sums = found.agg(F.count("*").alias("n_blocks"), F.count_if(hit).alias("n_read"), F.sum("length").alias("all"), F.sum(F.when(hit, F.col("length"))).alias("some"))
    return sums.select("n_blocks", "n_read", (F.coalesce("some", F.lit(0)) * F.col("n_blocks") <= 1.2 * F.col("n_read") * F.col("all")).alias("fewer_bytes"))
