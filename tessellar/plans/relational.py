"""The relational queries: every analysis step of the codec on rasters made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import costs, masks, statistics, transforms
from ..sources import rasters
from ..sources.rasters import SQL
from .registry import query

B8 = 'band, depth, CAST("row" // 8 AS BIGINT) AS bi, CAST(col // 8 AS BIGINT) AS bj'
E = 0.01


def on(raster: str, body: str, more: str = "") -> str:
    """``body`` with the raster as the relation px; ``more``: further relations."""
    return f"WITH px AS ({SQL[raster]}){', ' + more if more else ''} {body}"


def _blocks(error, size=8, extra=""):
    return (
        f'b AS (SELECT band, depth, CAST("row" // {size} AS BIGINT) AS bi, CAST(col // {size} AS BIGINT) AS bj, "row", col, z FROM px WHERE valid), '
        f"w AS (SELECT *, min(z) OVER (PARTITION BY band, depth, bi, bj) AS z_min FROM b), "
        f"q AS (SELECT *, CAST(floor((z - z_min) * CAST({1.0 / (2.0 * error)!r} AS DOUBLE) + 0.5) AS BIGINT) AS q FROM w)" + extra
    )


# ------------------------------------------------------------------ flagship


@query(on("embed", """SELECT band, depth, bi, bj, count(*) AS n, min(z_min) AS z_min, max(q) AS max_q,
    max(abs(z - least(z_min + q * CAST(0.02 AS DOUBLE), top))) AS max_error FROM q JOIN (SELECT band, depth, max(z) AS top FROM px GROUP BY ALL) USING (band, depth) GROUP BY band, depth, bi, bj""", _blocks(E)))  # fmt: skip
def quantize_error_blocks(spark, d):
    return transforms.quantize_error_blocks(rasters.embed(spark, d), E)


# ------------------------------------------------------------------ validity, no-data, NaN


@query(on("events", """SELECT band, CAST(("row" * 100 + col) // 8 AS BIGINT) AS byte_pos, CAST(sum(CASE WHEN valid THEN 128 >> CAST(("row" * 100 + col) % 8 AS INT) ELSE 0 END) AS BIGINT) AS byte FROM px GROUP BY ALL"""))
def mask_pack_bytes(spark, d):
    return masks.pack_mask(rasters.events(spark, d), 100)


@query(on("events", 'SELECT band, "row", col, valid FROM px'))
def mask_unpack(spark, d):
    px = rasters.events(spark, d)
    return masks.unpack_mask(masks.pack_mask(px, 100), 100, px)


@query(on("event_bands", "SELECT band, count(*) FILTER (valid) AS n_valid, count(*) AS n_pixels FROM px GROUP BY band"))
def count_valid(spark, d):
    return masks.count_valid(rasters.event_bands(spark, d))


@query(on("event_bands", """SELECT y.band, CAST(count(*) FILTER (x.valid IS NOT NULL AND y.valid <> x.valid) AS BIGINT) AS n_changed, bool_or(x.valid IS NULL OR x.valid <> y.valid) AS store
    FROM px y LEFT JOIN px x ON x.band = y.band - 1 AND x."row" = y."row" AND x.col = y.col GROUP BY y.band"""))  # fmt: skip
def mask_change_between_bands(spark, d):
    return masks.mask_changes(rasters.event_bands(spark, d))


@query(on("events", """SELECT CAST(b AS BIGINT) AS band, "row", col, CASE WHEN b = 0 THEN TRUE ELSE valid END AS valid FROM px, range(3) t(b)"""))
def mask_forward_fill(spark, d):
    px = rasters.events(spark, d)
    stored = [px.withColumn("band", F.lit(b).cast("bigint")).withColumn("valid", F.col("valid") if b == 1 else F.lit(None).cast("boolean")) for b in (0, 1, 2)]
    return masks.forward_fill_masks(stored[0].union(stored[1]).union(stored[2]))


@query(on("dirty", "SELECT band, bool_or(isnan(z) AND valid) AS has_nan, count(*) FILTER (isnan(z) AND valid) AS n_nan FROM px GROUP BY band"))
def has_nan(spark, d):
    return masks.has_nan(rasters.dirty(spark, d))


@query(on("dirty", """SELECT band, "row", col, depth, CASE WHEN isnan(z) THEN CAST(-1.7976931348623157e308 AS DOUBLE) ELSE z END AS z,
    valid AND count(*) FILTER (NOT isnan(z)) OVER (PARTITION BY band, "row", col) > 0 AS valid FROM px"""))  # fmt: skip
def nan_to_mask_v5(spark, d):
    return masks.nan_to_mask(rasters.dirty(spark, d))


@query(on("dirty", """SELECT band, "row", col, depth, CASE WHEN gone THEN 0.0 WHEN isnan(z) THEN -9999.0 ELSE z END AS z, NOT gone AS valid FROM
    (SELECT *, NOT valid OR count(*) FILTER (NOT isnan(z) AND z <> -9999) OVER (PARTITION BY band, "row", col) = 0 AS gone FROM px)"""))  # fmt: skip
def nodata_to_mask(spark, d):
    return masks.nodata_to_mask(rasters.dirty(spark, d), -9999.0)


@query(on("dirty", """SELECT band, "row", col, count(*) FILTER (isnan(z)) AS n_nan, count(*) FILTER (z = -9999) AS n_nodata,
    CASE WHEN count(*) FILTER (isnan(z) OR z = -9999) = count(*) THEN 'invalid' WHEN count(*) FILTER (isnan(z) OR z = -9999) > 0 THEN 'mixed' ELSE 'valid' END AS state FROM px GROUP BY band, "row", col"""))  # fmt: skip
def nan_nodata_classify(spark, d):
    return masks.classify_pixels(rasters.dirty(spark, d), -9999.0)


@query(on("dirty", """SELECT band, count(*) AS n_mixed FROM (SELECT band, "row", col, count(*) FILTER (isnan(z) OR z = -9999) AS e, count(*) AS n FROM px GROUP BY ALL) WHERE e > 0 AND e < n GROUP BY band"""))
def nodata_mixed_pixels(spark, d):
    return masks.mixed_pixels(rasters.dirty(spark, d), -9999.0)


@query(on("psize", "SELECT band, bool_and(z = floor(z + 0.5)) AND max(abs(z)) <= 8388608 AS as_float, bool_and(z = floor(z + 0.5)) AND max(abs(z)) <= 9007199254740992 AS as_double FROM px GROUP BY band")
       + " UNION ALL SELECT CAST(1 AS BIGINT), bool_and(z = floor(z + 0.5)) AND max(abs(z)) <= 8388608, bool_and(z = floor(z + 0.5)) AND max(abs(z)) <= 9007199254740992 FROM (" + SQL["events"] + ") WHERE valid")
def all_int_detect(spark, d):
    a, b = rasters.psize(spark, d), rasters.events(spark, d).withColumn("band", F.lit(1).cast("bigint"))
    return masks.all_integer(a.union(b))


_CLEAN = "SELECT band, min(z) AS lo, max(z) AS hi FROM px WHERE valid AND NOT isnan(z) AND z <> -9999 GROUP BY band"


@query(on("dirty", f"SELECT band, -9999 >= lo - 0.5 AND -9999 <= hi + 0.5 AS near_float, -9999 >= lo AND -9999 <= hi AS near_int FROM ({_CLEAN})"))
def nodata_distance_check(spark, d):
    return masks.nodata_distance(rasters.dirty(spark, d), -9999.0, 0.25)


@query(on("dirty", f"""SELECT band, any_value(lo) AS lo, max(x) AS stand_in FROM (SELECT band, lo, unnest([lo - CAST(1.0 AS DOUBLE), lo - CAST(0.0001 AS DOUBLE), lo - CAST(0.001 AS DOUBLE), lo - CAST(0.01 AS DOUBLE), lo - CAST(0.1 AS DOUBLE), lo - 1, lo - 10, lo - 100, lo - 1000, lo - 10000,
    CASE WHEN lo > 0 THEN lo / 2 ELSE lo * 2 END]) AS x FROM ({_CLEAN})) WHERE x < lo - CAST(0.5 AS DOUBLE) GROUP BY band"""))  # fmt: skip
def nodata_remap_candidate(spark, d):
    return masks.nodata_remap(rasters.dirty(spark, d), -9999.0, 0.25)


@query(on("events", 'SELECT band, "row", col, depth, CASE WHEN valid AND z = 50 THEN -1.0 ELSE z END AS z, valid FROM px'))
def nodata_restore(spark, d):
    return masks.nodata_restore(rasters.events(spark, d), 50.0, -1.0)


@query(on("event_bands", 'SELECT band, "row", col, depth, CASE WHEN valid THEN nullif(z, 50.0) END AS z FROM px'))
def masked_view(spark, d):
    return masks.masked_view(rasters.event_bands(spark, d), 50.0)


@query(on("event_bands", 'SELECT "row", col, bool_and(valid) AS valid FROM px GROUP BY ALL'))
def mask_intersection(spark, d):
    return masks.mask_intersection(rasters.event_bands(spark, d))


@query(on("events", 'SELECT band, "row", col, depth, CASE WHEN valid THEN z ELSE -1.0 END AS z FROM px'))
def fill_nodata(spark, d):
    return masks.fill_nodata(rasters.events(spark, d), -1.0, -3.4e38, 3.4e38)


# ------------------------------------------------------------------ statistics and ranges


@query(on("embed4", "SELECT band, depth, min(z) AS z_min, max(z) AS z_max FROM px WHERE valid GROUP BY ALL"))
def data_ranges(spark, d):
    return statistics.data_ranges(rasters.embed(spark, d, 4))


@query(on("embed4", "SELECT coalesce(band, -1) AS band, coalesce(depth, -1) AS depth, min(z) AS z_min, max(z) AS z_max, count(*) AS n FROM px WHERE valid GROUP BY ROLLUP (band, depth)"))
def overall_range(spark, d):
    return statistics.overall_range(rasters.embed(spark, d, 4)).fillna(-1, ["band", "depth"])


@query(on("event_bands", "SELECT band, bool_and(a = b) AS constant_depths, min(a) = max(b) AS constant_band FROM (SELECT band, depth, min(z) AS a, max(z) AS b FROM px WHERE valid GROUP BY ALL) GROUP BY band"))
def constant_detect(spark, d):
    return statistics.constant(rasters.event_bands(spark, d))


_SAME = 's AS (SELECT *, lag(z) OVER (PARTITION BY band, depth, bi, bj ORDER BY "row", col) AS p FROM b)'
_B = 'b AS (SELECT band, depth, CAST("row" // 8 AS BIGINT) AS bi, CAST(col // 8 AS BIGINT) AS bj, "row", col, z FROM px WHERE valid)'


@query(on("psize_masked", "SELECT *, n > 4 AND z_max > z_min + 1.5 AND 2 * n_same > n AS try_lut FROM (SELECT band, depth, bi, bj, count(*) AS n, min(z) AS z_min, max(z) AS z_max, count(*) FILTER (z = p) AS n_same FROM s GROUP BY ALL)", _B + ", " + _SAME))
def block_stats(spark, d):
    return statistics.block_stats(rasters.psize(spark, d, True), 8, 0.5)


@query(on("psize_masked", "SELECT band, depth, bi, bj, n > 4 AND hi > lo + 1.5 AND 2 * s > n AS try_lut FROM (SELECT band, depth, bi, bj, count(*) AS n, min(z) AS lo, max(z) AS hi, count(*) FILTER (z = p) AS s FROM s GROUP BY ALL)", _B + ", " + _SAME))
def block_try_lut(spark, d):
    return statistics.block_stats(rasters.psize(spark, d, True), 8, 0.5).select(*statistics.BLOCK, "try_lut")


@query(on("events", "SELECT coalesce(min(z), -1.0) AS z_min, coalesce(max(z), -1.0) AS z_max FROM px WHERE valid AND z <> 50"))
def find_data_range(spark, d):
    return statistics.find_data_range(rasters.events(spark, d), 50.0)


@query(on("events", "SELECT band, max(CASE WHEN valid THEN abs(z - CAST(floor(z * 10 + 0.5) AS DOUBLE) / 10) END) AS max_error, CAST(0 AS BIGINT) AS n_mask_diff FROM px GROUP BY band"))
def max_abs_error(spark, d):
    px = rasters.events(spark, d)
    return statistics.max_abs_error(px, px.withColumn("z", F.floor(F.col("z") * 10 + 0.5).cast("double") / 10))


@query(on("dirty", """SELECT band, min(a) AS z_min, max(b) AS z_max, string_agg(CAST(CAST(round(a * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY depth) AS depth_mins, string_agg(CAST(CAST(round(b * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY depth) AS depth_maxs
    FROM (SELECT band, depth, min(z) AS a, max(z) AS b FROM px WHERE NOT isnan(z) GROUP BY ALL) GROUP BY band"""))  # fmt: skip
def band_stats(spark, d):
    return statistics.band_stats(rasters.dirty(spark, d).filter(~F.isnan("z")))


@query(on("psize", "SELECT band, CAST(z AS BIGINT) % 256 AS bin, count(*) AS n FROM px WHERE valid GROUP BY ALL"))
def value_histogram(spark, d):
    return statistics.histogram(rasters.psize(spark, d))


@query(on("psize_masked", """SELECT band, ((CAST(z - coalesce(CASE WHEN lv THEN l END, CASE WHEN av THEN a END, p, 0) AS BIGINT) % 256) + 256) % 256 AS bin, count(*) AS n FROM (
    SELECT *, lag(z) OVER r AS l, lag(valid) OVER r AS lv, lag(z) OVER c AS a, lag(valid) OVER c AS av, last_value(CASE WHEN valid THEN z END IGNORE NULLS) OVER (PARTITION BY band ORDER BY "row", col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
    FROM px WINDOW r AS (PARTITION BY band, "row" ORDER BY col), c AS (PARTITION BY band, col ORDER BY "row")) WHERE valid GROUP BY ALL"""))  # fmt: skip
def delta_histogram(spark, d):
    return statistics.delta_histogram(rasters.psize(spark, d, True))


@query(on("orders", "SELECT band, CAST(k AS BIGINT) AS plane, (CAST(floor(z) AS BIGINT) >> CAST(8 * k AS INT)) & 255 AS byte, count(*) AS n FROM px, range(4) t(k) GROUP BY ALL"))
def byte_histogram(spark, d):
    return statistics.byte_histogram(rasters.orders(spark, d).withColumn("z", F.floor("z").cast("double")))


def _entropy(value):
    return f"""SELECT band, CAST(ceil(sum(n * log2(t / n)) / 8 - 1e-9) AS BIGINT) AS bytes, CAST(max(t) AS BIGINT) AS n FROM (SELECT band, b, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY band) AS t FROM
    (SELECT band, "row" * 50 + col AS k, (({value}) % 256 + 256) % 256 AS b FROM px) WHERE k % 7 = 0 GROUP BY band, b) GROUP BY band"""


@query(on("psize", _entropy("CAST(z AS BIGINT)")))
def entropy_bytes(spark, d):
    return statistics.entropy_bytes(rasters.psize(spark, d), 50)


@query(on("psize", _entropy('CAST(z - coalesce(lag(z) OVER (PARTITION BY band, "row" ORDER BY col), 0) AS BIGINT)')))
def entropy_bytes_delta(spark, d):
    return statistics.entropy_bytes(rasters.psize(spark, d), 50, delta=True)


_PAIRS = """n AS (SELECT band, depth, CAST(z AS BIGINT) AS v, valid, lead(CAST(z AS BIGINT)) OVER r AS x, lead(valid) OVER r AS xv, lead(CAST(z AS BIGINT)) OVER c AS y, lead(valid) OVER c AS yv FROM px WINDOW r AS (PARTITION BY band, "row" ORDER BY col), c AS (PARTITION BY band, col ORDER BY "row")),
    p AS (SELECT band, depth, xor(v, x) AS d FROM n WHERE valid AND xv UNION ALL SELECT band, depth, xor(v, y) FROM n WHERE valid AND yv)"""


@query(on("psize_masked", "SELECT band, depth, CAST(b AS BIGINT) AS bit, count(*) AS n_pairs, CAST(sum((d >> CAST(b AS INT)) & 1) AS BIGINT) AS n_diff FROM p, range(8) t(b) GROUP BY ALL", _PAIRS))
def bitplane_xor_counts(spark, d):
    return statistics.bitplane_counts(rasters.psize(spark, d, True))


#: All pixels are valid: no pair starts in the last row or column.
_PLAIN_PAIRS = """e AS (SELECT *, max("row") OVER (PARTITION BY band) AS r1, max(col) OVER (PARTITION BY band) AS c1 FROM px),
    n AS (SELECT band, "row", col, r1, c1, CAST(floor(z) AS BIGINT) AS v, lead(CAST(floor(z) AS BIGINT)) OVER r AS x, lead(CAST(floor(z) AS BIGINT)) OVER c AS y FROM e WINDOW r AS (PARTITION BY band, "row" ORDER BY col), c AS (PARTITION BY band, col ORDER BY "row")),
    p AS (SELECT band, xor(v, x) AS d FROM n WHERE x IS NOT NULL AND "row" < r1 UNION ALL SELECT band, xor(v, y) FROM n WHERE y IS NOT NULL AND col < c1),
    t AS (SELECT band, b, count(*) AS n, abs(1 - 2 * CAST(sum((d >> CAST(b AS INT)) & 1) AS DOUBLE) / count(*)) < 0.05 AS noise FROM p, range(32) t(b) GROUP BY ALL),
    u AS (SELECT *, lag(noise) OVER (PARTITION BY band ORDER BY b) AS below FROM t),
    k AS (SELECT band, CASE WHEN max(n) < 5000 OR (SELECT count(*) FROM px) < 5000 THEN 0 ELSE coalesce(max(CASE WHEN noise AND below THEN b END), min(CASE WHEN noise THEN b END), 0) END AS cut FROM u GROUP BY band)"""


@query(on("orders", "SELECT band, CAST(cut AS BIGINT) AS planes, CAST(floor(pow(2.0, cut) / 2) AS BIGINT) AS max_error FROM k", _PLAIN_PAIRS))
def bitplane_noise_cut(spark, d):
    return statistics.bitplane_noise_cut(rasters.orders(spark, d).withColumn("z", F.floor("z").cast("double")), 0.05, 32)


# ------------------------------------------------------------------ error-bound transforms


@query(on("events", "SELECT DISTINCT floor(z / 2.5) / 4 AS e, CAST(greatest(0.5, floor(floor(z / 2.5) / 4)) AS DOUBLE) AS max_error FROM px"))
def norm_max_z_error(spark, d):
    """The bounds that integer encoding uses for requested ones (quarters, from the event values)."""
    es = rasters.events(spark, d).select((F.floor(F.col("z") / 2.5) / 4).alias("e")).distinct()
    return es.select("e", F.greatest(F.lit(0.5), F.floor("e").cast("double")).alias("max_error"))


@query(on("events", "SELECT band, count(*) AS n, coalesce((SELECT max(s) / 2 FROM (SELECT s, max(abs(floor(z / s + 0.5) - z / s) * s) AS r FROM px, (SELECT unnest([CAST(1.0 AS DOUBLE), 0.5, 0.1, 0.05, 0.01, 0.005, 0.001, 0.0005, 0.0001]) AS s) WHERE valid AND s / 2 > CAST(0.001 AS DOUBLE) GROUP BY s) WHERE r <= CAST(0.0005 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS max_error FROM px WHERE valid GROUP BY band"))
def raise_max_z_error(spark, d):
    return transforms.raise_error(rasters.events(spark, d), 0.001)


@query(on("events", 'SELECT band, depth, bi, bj, "row", col, z, z_min, q FROM q', _blocks(0.05)))
def quantize_blocks(spark, d):
    return transforms.quantize(rasters.events(spark, d), 0.05)


@query(on("events", 'SELECT band, depth, "row", col, least(z_min + q * CAST(0.1 AS DOUBLE), top) AS y FROM q JOIN (SELECT band, depth, max(z) AS top FROM px WHERE valid GROUP BY ALL) USING (band, depth)', _blocks(0.05)))
def dequantize_blocks(spark, d):
    px = rasters.events(spark, d)
    return transforms.dequantize(transforms.quantize(px, 0.05), statistics.data_ranges(px), 0.05).select("band", "depth", "row", "col", "y")


def _width(x):
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE CAST(floor(log2({x})) AS BIGINT) + 1 END"


@query(on("events", f"SELECT band, depth, bi, bj, count(*) AS n, max(q) AS max_q, {_width('max(q)')} AS bits FROM q GROUP BY ALL", _blocks(0.05)))
def block_quant_bits(spark, d):
    return costs.block_quant_bits(rasters.events(spark, d), 0.05)


def _offset(z):
    i = f"{z} = floor({z})"
    return f"CASE WHEN {i} AND {z} BETWEEN -32768 AND 32767 THEN 2 WHEN {i} AND {z} BETWEEN -2147483648 AND 2147483647 THEN 4 WHEN CAST(CAST({z} AS FLOAT) AS DOUBLE) = {z} THEN 4 ELSE 8 END"


def _cost(error, size, raw=8, offset=None, first="NULL"):
    """Relations up to c: (block keys, n, mode, bytes)."""
    return _blocks(error, size) + f""", l AS (SELECT *, lag(z, 1, {first}) OVER (PARTITION BY band, depth, bi, bj ORDER BY "row", col) AS p FROM q),
    g AS (SELECT band, depth, bi, bj, count(*) AS n, min(z) AS lo, max(z) AS hi, count(DISTINCT q) AS dq, count(*) FILTER (z = p) AS same, CAST(floor((max(z) - min(z)) * CAST({1.0 / (2.0 * error)!r} AS DOUBLE) + 0.5) AS BIGINT) AS mq FROM l GROUP BY ALL),
    s AS (SELECT *, 1 + {offset or _offset('lo')} AS head, 2 + n // 256 + (n * ({_width('mq')}) + 7) // 8 AS simple, 3 + n // 256 + ((dq - 1) * ({_width('mq')}) + 7) // 8 + (n * ({_width('(dq - 1)')}) + 7) // 8 AS dict, n > 4 AND hi > lo + {3 * error} AND 2 * same > n AND dq < 256 AS try FROM g),
    t AS (SELECT *, try AND dict < simple AS use, head + CASE WHEN mq = 0 THEN 0 WHEN try AND dict < simple THEN dict ELSE simple END AS packed, 1 + n * {raw} AS raw FROM s),
    c AS (SELECT band, depth, bi, bj, n, CASE WHEN lo = 0 AND hi = 0 THEN 'zero' WHEN mq > 1073741823 OR packed >= raw THEN 'raw' WHEN mq = 0 THEN 'constant' WHEN use THEN 'lut' ELSE 'stuffed' END AS mode,
        CAST(CASE WHEN lo = 0 AND hi = 0 THEN 1 WHEN mq > 1073741823 OR packed >= raw THEN raw ELSE packed END AS BIGINT) AS bytes FROM t)"""


@query(on("events", "SELECT * FROM c", _cost(0.05, 8)))
def tile_cost_bytes(spark, d):
    return costs.tile_costs(rasters.events(spark, d), 0.05, "double")


@query(on("psize", "SELECT band, mode, count(*) AS n_blocks, CAST(sum(bytes) AS BIGINT) AS bytes FROM c GROUP BY ALL", _cost(0.5, 8, 1, "1")))
def block_encode_mode(spark, d):
    return costs.tile_cost_total(rasters.psize(spark, d), 0.5, "uchar")


@query("SELECT *, CAST(CASE WHEN bytes_16 <= bytes_8 THEN 16 ELSE 8 END AS BIGINT) AS block FROM (" + on("events", "SELECT band, CAST(sum(bytes) AS BIGINT) AS bytes_8 FROM c GROUP BY band", _cost(0.05, 8)) + ") JOIN (" + on("events", "SELECT band, CAST(sum(bytes) AS BIGINT) AS bytes_16 FROM c GROUP BY band", _cost(0.05, 16)) + ") USING (band)")
def block_size_choice(spark, d):
    return costs.block_size_choice(rasters.events(spark, d), 0.05, "double")


@query(on("events", f"SELECT band, depth, bi, bj, {_offset('min(z)')} AS offset_bytes FROM b GROUP BY ALL", _B))
def reduce_offset_type(spark, d):
    r = transforms.block_ranges(rasters.events(spark, d))
    return r.select(*statistics.BLOCK, costs.offset_bytes(F.col("z_min"), "double").alias("offset_bytes"))


@query(on("psize", 'SELECT band, depth, bi, bj, "row", col, q, CAST(dense_rank() OVER (PARTITION BY band, depth, bi, bj ORDER BY q) - 1 AS BIGINT) AS lut_index FROM q', _blocks(0.5)))
def block_lut_index(spark, d):
    return costs.lut_index(rasters.psize(spark, d), 0.5)


@query(on("psize", f"""SELECT band, depth, bi, bj, CAST(2 + (n * ({_width('mq')}) + 7) // 8 AS BIGINT) AS simple, CAST(3 + ((dq - 1) * ({_width('mq')}) + 7) // 8 + (n * ({_width('(dq - 1)')}) + 7) // 8 AS BIGINT) AS dict
    FROM (SELECT band, depth, bi, bj, count(*) AS n, max(q) AS mq, count(DISTINCT q) AS dq FROM q GROUP BY ALL)""", _blocks(0.5)))  # fmt: skip
def block_lut_cost(spark, d):
    q = transforms.quantize(rasters.psize(spark, d), 0.5).groupBy(*statistics.BLOCK).agg(F.count("*").alias("n"), F.max("q").alias("m"), F.count_distinct("q").alias("k"))
    return q.select(*statistics.BLOCK, costs.stuffed_bytes(F.col("n"), F.col("m")).alias("simple"), costs.lut_bytes(F.col("n"), F.col("m"), F.col("k")).alias("dict"))


@query(on("psize", "SELECT band, depth, bi, bj, count(DISTINCT q) - 1 AS changes FROM q GROUP BY ALL", _blocks(0.5)))
def block_distinct(spark, d):
    return costs.block_distinct(rasters.psize(spark, d), 0.5)


@query(on("psize_masked", """SELECT band, depth, "row", min(col) AS start, count(*) AS length, min(z) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY "row" ORDER BY col) AS run FROM
    (SELECT *, CASE WHEN z = lag(z) OVER r AND col = lag(col) OVER r + 1 THEN 0 ELSE 1 END AS new FROM px WHERE valid WINDOW r AS (PARTITION BY "row" ORDER BY col))) GROUP BY band, depth, "row", run"""))  # fmt: skip
def rle_runs(spark, d):
    return costs.rle_runs(rasters.psize(spark, d, True), 50)


@query(on("psize", """SELECT band, ((start % 256) + 256) % 256 AS start, 257 - gap AS length FROM (SELECT band, nxt AS start, gap, row_number() OVER (PARTITION BY band ORDER BY gap DESC, nxt) AS k FROM
    (SELECT band, nxt, nxt - bin AS gap FROM (SELECT band, bin, coalesce(lead(bin) OVER (PARTITION BY band ORDER BY bin), min(bin) OVER (PARTITION BY band) + 256) AS nxt FROM (SELECT DISTINCT band, CAST(z AS BIGINT) AS bin FROM px)))) WHERE k = 1"""))  # fmt: skip
def huffman_code_range(spark, d):
    return costs.code_range(rasters.psize(spark, d))


# ------------------------------------------------------------------ deltas, derivatives, layout


@query(on("embed4", 'SELECT band, "row", col, depth, z - coalesce(lag(z) OVER (PARTITION BY band, "row", col ORDER BY depth), 0) AS delta FROM px'))
def depth_delta(spark, d):
    return transforms.depth_delta(rasters.embed(spark, d, 4))


@query(on("embed4", """SELECT band, depth, max(x) AS lost, max(x) <= CAST(0.01 AS DOUBLE) / 8 AS usable FROM (SELECT band, depth, abs(CAST(CAST(z - p AS FLOAT) AS DOUBLE) + p - z) AS x FROM
    (SELECT *, lag(z) OVER (PARTITION BY band, "row", col ORDER BY depth) AS p FROM px) WHERE p IS NOT NULL) GROUP BY ALL"""))  # fmt: skip
def depth_delta_float(spark, d):
    return transforms.depth_delta_float(rasters.embed(spark, d, 4), 0.01)


_ROW = 'z - coalesce(lag(z) OVER (PARTITION BY band, depth, "row" ORDER BY col), 0)'


@query(on("psize", f'SELECT band, "row", col, depth, {_ROW} AS d FROM px'))
def row_derivative(spark, d):
    return transforms.row_derivative(rasters.psize(spark, d))


@query(on("psize", f'SELECT band, "row", col, depth, d - coalesce(lag(d) OVER (PARTITION BY band, depth, col ORDER BY "row"), 0) AS d FROM (SELECT *, {_ROW} AS d FROM px)'))
def cross_derivative(spark, d):
    return transforms.cross_derivative(rasters.psize(spark, d))


@query(on("psize", 'SELECT band, "row", col, depth, z FROM px'))
def restore_derivative(spark, d):
    return transforms.restore(transforms.row_derivative(rasters.psize(spark, d)))


@query(on("psize", 'SELECT band, "row", col, depth, z FROM px'))
def restore_cross(spark, d):
    return transforms.restore(transforms.cross_derivative(rasters.psize(spark, d)), cross=True)


@query(on("orders", 'SELECT band, "row", col, depth, CAST(k AS BIGINT) AS plane, (CAST(floor(z) AS BIGINT) >> CAST(8 * k AS INT)) & 255 AS byte FROM px, range(4) t(k)'))
def byte_planes(spark, d):
    return transforms.byte_planes(rasters.orders(spark, d).withColumn("z", F.floor("z").cast("double")))


@query(on("psize", 'SELECT band, "row", col, depth, CAST(((CASE WHEN col > 1 THEN x - lag(x) OVER (PARTITION BY band, "row" ORDER BY col) ELSE x END) % 256 + 256) % 256 AS BIGINT) AS byte FROM (SELECT *, CAST(z - coalesce(lag(z) OVER (PARTITION BY band, "row" ORDER BY col), 0) AS BIGINT) AS x FROM px)'))
def byte_derivative(spark, d):
    return transforms.byte_derivative(rasters.psize(spark, d), 2)


@query(on("embed4", 'SELECT ("row" * 16 + col) * 4 + depth AS bip, depth * (SELECT (max("row") + 1) * 16 FROM px) + "row" * 16 + col AS bsq, z FROM px'))
def interleave_swap(spark, d):
    return transforms.interleave_swap(rasters.embed(spark, d, 4), 16, 4)


@query(on("orders", 'SELECT band, "row", col, depth, CAST(floor(z + 0.5) AS BIGINT) AS v FROM px'))
def round_half_up_cast(spark, d):
    return transforms.round_half_up(rasters.orders(spark, d))


@query(on("psize", 'SELECT band, "row", col, depth, CAST(CAST(z AS UTINYINT) AS DOUBLE) AS z FROM px'))
def widen_to_double(spark, d):
    return rasters.psize(spark, d).select("band", "row", "col", "depth", F.col("z").cast("short").cast("double").alias("z"))


@query(on("event_bands", 'SELECT band, "row", col, depth, z FROM px WHERE band < 1'))
def band_prefix(spark, d):
    return rasters.event_bands(spark, d).filter("band < 1").select("band", "row", "col", "depth", "z")


@query(on("events", 'SELECT band, "row", col, depth, CASE WHEN valid THEN lo ELSE 0.0 END AS z FROM px JOIN (SELECT band, depth, min(z) AS lo FROM px WHERE valid GROUP BY ALL) USING (band, depth)'))
def fill_constant(spark, d):
    return transforms.fill_constant(rasters.events(spark, d))
