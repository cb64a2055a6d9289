"""How a whole band would be encoded, and in how many bytes, before anything is written: the candidates' sizes side by side, and the format's rules on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import planes, prefix
from .costs import SIZES, block_size_choice
from .statistics import delta_histogram, histogram

#: Fixed values of the format: float planes must be a tenth smaller than tiles; large tiles are tried below this many bits a value.
PLANES_GAIN, LOW_BITS = 0.9, 1.5


def plane_estimate(px: DataFrame, kind: str) -> DataFrame:
    """band, planes_bytes: what coded float planes would take, scaled up from the sampled stripes (head of the stream, and of each plane, included)."""
    size = planes.KINDS[kind][2]
    shape = planes.shapes(px)
    counted = planes.stripes_of(shape).groupBy("band").agg(F.sum(F.floor((F.col("end") - F.col("begin") - 1) / planes.STEP) + 1).alias("counted"))
    least = planes.predictors(px, kind).select("band", F.least("as_is", "along_rows", "along_both").alias("least"))
    x = shape.join(counted, "band").join(least, "band")
    scaled = F.ceil(F.col("least") * F.col("height") * F.col("width") / F.col("counted"))
    return x.select("band", (1 + 6 * size + scaled).cast("bigint").alias("planes_bytes"))


def image_modes(px: DataFrame, kind: str, error: float) -> DataFrame:
    """Per band of ``px`` (values of type ``kind`` within ``error``): bytes of tiles of both sizes, of coded values and differences (8-bit values without loss), of float planes (floats
    without loss; an estimate) and raw; the mode the format's encoder takes and the bytes of its data.

    Tiles are the start; codes win if smaller, planes if a tenth smaller; then tiles of 16 if no larger, where they could pay; then raw bytes if no larger. Each candidate is one aggregate
    of the pixels (blocks share one shuffle, differences take one on stripes, values are counted in their tasks), and what meets are rows a band."""
    size = SIZES[kind]
    codes, floats = kind == "uchar" and error == 0.5, kind in planes.KINDS and error == 0
    none = F.lit(None).cast("bigint")
    shape = px.groupBy("band").agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), (F.max("depth") + 1).alias("depths"), F.count_if("valid").alias("n"),
        F.min(F.when(F.col("valid"), F.col("z"))).alias("z_min"), F.max(F.when(F.col("valid"), F.col("z"))).alias("z_max"),
    )
    x = shape.join(block_size_choice(px, error, kind).select("band", "bytes_8", "bytes_16"), "band", "left")
    if codes:
        x = x.join(prefix.value_or_delta(histogram(px), delta_histogram(px), ["band"]).select("band", "value_bytes", "delta_bytes", "choice", F.col("bytes").alias("coded")), "band", "left")
    else:
        x = x.select("*", none.alias("value_bytes"), none.alias("delta_bytes"), F.lit(None).cast("string").alias("choice"), none.alias("coded"))
    x = x.join(plane_estimate(px, kind), "band", "left") if floats else x.withColumn("planes_bytes", none)
    tiles, raw = F.col("bytes_8"), F.col("n") * size
    coded = F.coalesce(F.col("coded") < tiles, F.lit(False))
    planar = F.coalesce(F.col("planes_bytes") < F.lit(PLANES_GAIN) * tiles, F.lit(False))
    first = F.when(coded, F.col("choice")).when(planar, "planes").otherwise("tiles 8")
    now = F.when(coded, F.col("coded")).when(planar, F.col("planes_bytes")).otherwise(tiles)
    other: Column = F.coalesce("coded", "planes_bytes")
    x = x.withColumn("first", first).withColumn("now", now)
    tries = (tiles * 8 < F.col("height") * F.col("width") * F.col("depths") * LOW_BITS) & (tiles < 4 * raw) & (other.isNull() | (tiles < 2 * other)) & ((F.col("height") > 8) | (F.col("width") > 8))
    wide = tries & (F.col("bytes_16") <= F.col("now"))
    x = x.withColumn("mode", F.when(wide, "tiles 16").otherwise(F.col("first"))).withColumn("now", F.when(wide, F.col("bytes_16")).otherwise(F.col("now")) + int(codes or floats))
    swept = raw <= F.col("now")
    flat = F.col("z_min") == F.col("z_max")
    mode = F.when(F.col("n") == 0, "empty").when(flat, "constant").when(swept, "raw").otherwise(F.col("mode"))
    data = F.when((F.col("n") == 0) | flat, 0).when(swept, raw).otherwise(F.col("now"))
    return x.select("band", "n", "bytes_8", "bytes_16", "value_bytes", "delta_bytes", "planes_bytes", raw.alias("raw_bytes"), mode.alias("mode"), data.cast("bigint").alias("bytes"))
