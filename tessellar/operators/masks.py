"""Validity, no-data and NaN operators over pixel relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIXEL = ["band", "row", "col"]
#: The smallest float32 and float64, which stood for NaN in old format versions.
LOWEST = {"float": -3.4028234663852886e38, "double": -1.7976931348623157e308}


def pack_mask(px: DataFrame, width: int) -> DataFrame:
    """Mask bytes, most significant bit first: byte k >> 3 holds pixel k at bit 0x80 >> (k & 7)."""
    k = F.col("row") * width + F.col("col")
    bit = F.when(F.col("valid"), F.expr(f"shiftright(128, cast((row * {width} + col) % 8 as int))")).otherwise(0)
    return px.filter("depth = 0").groupBy("band", F.floor(k / 8).cast("bigint").alias("byte_pos")).agg(F.sum(bit).cast("bigint").alias("byte"))


def unpack_mask(packed: DataFrame, width: int, pixels: DataFrame) -> DataFrame:
    """The inverse: (band, row, col, valid) of the pixels that the bytes cover and the raster has."""
    bits = packed.select("band", "byte_pos", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"), "byte")
    k = F.col("byte_pos") * 8 + F.col("i")
    on = F.expr("(shiftright(cast(byte as int), 7 - i) & 1) = 1")
    out = bits.select("band", F.floor(k / width).cast("bigint").alias("row"), (k % width).cast("bigint").alias("col"), on.alias("valid"))
    return out.join(pixels.filter("depth = 0").select(*PIXEL), PIXEL, "left_semi")


def count_valid(px: DataFrame) -> DataFrame:
    return px.filter("depth = 0").groupBy("band").agg(F.count_if("valid").alias("n_valid"), F.count("*").alias("n_pixels"))


def mask_changes(px: DataFrame) -> DataFrame:
    """For each band whether its mask differs from the band before, i.e. has to be stored again (the first one always), and in how many pixels."""
    w = W.partitionBy("row", "col").orderBy("band")
    prev = px.filter("depth = 0").withColumn("prev", F.lag("valid").over(w))
    return prev.groupBy("band").agg(F.count_if(F.col("valid") != F.col("prev")).alias("n_changed"), F.bool_or(F.col("prev").isNull() | (F.col("valid") != F.col("prev"))).alias("store"))


def forward_fill_masks(stored: DataFrame) -> DataFrame:
    """``stored`` (band, row, col, valid nullable): a band without a mask takes the last one before it; none before: all valid."""
    w = W.partitionBy("row", "col").orderBy("band").rowsBetween(W.unboundedPreceding, 0)
    return stored.select(*PIXEL, F.coalesce(F.last("valid", ignorenulls=True).over(w), F.lit(True)).alias("valid"))


def has_nan(px: DataFrame) -> DataFrame:
    return px.groupBy("band").agg(F.bool_or(F.isnan("z") & F.col("valid")).alias("has_nan"), F.count_if(F.isnan("z") & F.col("valid")).alias("n_nan"))


def nan_to_mask(px: DataFrame, kind: str = "double") -> DataFrame:
    """Old versions: a valid pixel that is NaN (or null) in all depths becomes invalid; other NaNs become the type's lowest value."""
    w = W.partitionBy(*PIXEL)
    gone = F.count_if(~F.isnan("z") & F.col("z").isNotNull()).over(w) == 0
    return px.select(*PIXEL, "depth", F.when(F.isnan("z"), F.lit(LOWEST[kind])).otherwise(F.col("z")).alias("z"), (F.col("valid") & ~gone).alias("valid"))


def classify_pixels(px: DataFrame, nodata: float) -> DataFrame:
    """One row a pixel: how many depths hold a value, NaN and no-data, and its state: valid, mixed or invalid."""
    n_nd = F.count_if(F.col("z") == nodata)
    n_nan = F.count_if(F.isnan("z"))
    g = px.groupBy(*PIXEL).agg(F.count("*").alias("n"), n_nan.alias("n_nan"), n_nd.alias("n_nodata"), F.bool_and("valid").alias("marked"))
    bad = F.col("n_nan") + F.col("n_nodata")
    state = F.when(~F.col("marked") | (bad == F.col("n")), "invalid").when(bad > 0, "mixed").otherwise("valid")
    return g.select(*PIXEL, "n_nan", "n_nodata", state.alias("state"))


def nodata_to_mask(px: DataFrame, nodata: float) -> DataFrame:
    """Values after normalisation: pixels without any value are invalid and 0; in mixed pixels NaN becomes the no-data value."""
    w = W.partitionBy(*PIXEL)
    empty = F.isnan("z") | F.coalesce(F.col("z") == nodata, F.lit(True))
    gone = F.min(empty.cast("int")).over(w) == 1
    rows = px.withColumn("gone", gone | ~F.col("valid"))
    z = F.when(F.col("gone"), 0.0).when(F.isnan("z"), F.lit(nodata)).otherwise(F.col("z"))
    return rows.select(*PIXEL, "depth", z.alias("z"), (~F.col("gone")).alias("valid"))


def all_integer(px: DataFrame) -> DataFrame:
    """Whether a band holds only integers that the type keeps exactly (below 2**23 for float, 2**53 for double)."""
    v = px.filter(F.col("valid") & ~F.isnan("z"))
    g = v.groupBy("band").agg(F.bool_and(F.col("z") == F.floor(F.col("z") + 0.5)).alias("whole"), F.max(F.abs("z")).alias("top"))
    return g.select("band", (F.col("whole") & (F.col("top") <= 2.0**23)).alias("as_float"), (F.col("whole") & (F.col("top") <= 2.0**53)).alias("as_double"))


def nodata_distance(px: DataFrame, nodata: float, error: float) -> DataFrame:
    """Whether the no-data value is so near to the valid range that rounding could reach it (within 2 e for floats, floor(e) for integers)."""
    v = px.filter(F.col("valid") & ~F.isnan("z") & (F.col("z") != nodata)).groupBy("band").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    near = lambda d: (F.lit(nodata) >= F.col("lo") - d) & (F.lit(nodata) <= F.col("hi") + d)
    return v.select("band", near(F.lit(2.0) * F.lit(error)).alias("near_float"), near(F.floor(F.lit(error)).cast("double")).alias("near_int"))


def nodata_remap(px: DataFrame, nodata: float, error: float) -> DataFrame:
    """A stand-in for the no-data value close below the range: of min - {4 e, 1e-4 .. 1e4} and min halved or doubled (whichever is lower) the largest below min - 2 e."""
    low = px.filter(F.col("valid") & ~F.isnan("z") & (F.col("z") != nodata)).groupBy("band").agg(F.min("z").alias("lo"))
    steps = F.array(*[F.lit(float(s)) for s in (4 * error, *[10.0**k for k in range(-4, 5)])])
    options = F.concat(F.transform(steps, lambda s: F.col("lo") - s), F.array(F.when(F.col("lo") > 0, F.col("lo") / 2).otherwise(F.col("lo") * 2)))
    return low.select("band", "lo", F.array_max(F.filter(options, lambda x: x < F.col("lo") - 2 * error)).alias("stand_in"))


def nodata_restore(px: DataFrame, internal: float, original: float) -> DataFrame:
    return px.select(*PIXEL, "depth", F.when(F.col("valid") & (F.col("z") == internal), F.lit(original)).otherwise(F.col("z")).alias("z"), "valid")


def masked_view(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Values with invalid pixels and no-data values as null."""
    z = F.when(F.col("valid"), F.col("z"))
    return px.select(*PIXEL, "depth", (z if nodata is None else F.nullif(z, F.lit(nodata))).alias("z"))


def mask_intersection(px: DataFrame) -> DataFrame:
    return px.groupBy("row", "col").agg(F.bool_and("valid").alias("valid"))


def fill_nodata(px: DataFrame, value: float, low: float, high: float) -> DataFrame:
    """Invalid values replaced by ``value`` where the type's range holds it."""
    ok = low <= value <= high
    return px.select(*PIXEL, "depth", (F.when(F.col("valid"), F.col("z")).otherwise(F.lit(value)) if ok else F.col("z")).alias("z"))


def mixed_pixels(px: DataFrame, nodata: float) -> DataFrame:
    """Pixels that hold no value in some depths but not in all: only these need a no-data value in the blob."""
    empty = F.isnan("z") | (F.col("z") == nodata)
    g = px.groupBy(*PIXEL).agg(F.count_if(empty).alias("n_empty"), F.count("*").alias("n"))
    return g.filter("n_empty between 1 and n - 1").groupBy("band").agg(F.count("*").alias("n_mixed"))
