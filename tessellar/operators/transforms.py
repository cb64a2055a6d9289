"""Error-bounded quantisation, its inverse, and delta, derivative and layout transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .statistics import BLOCK, STRIPE, data_ranges, in_stripe, striped, valid, with_blocks

#: The largest quantum a block may need, for 1- and 2-byte types and for the others.
MAX_QUANTUM = {1: (1 << 15) - 1, 2: (1 << 15) - 1, 4: (1 << 30) - 1, 8: (1 << 30) - 1}
#: Error bounds tried for floats, coarsest first; half of each is used.
ROUND_STEPS = (1.0, 0.5, 0.1, 0.05, 0.01, 0.005, 0.001, 0.0005, 0.0001)


def integer_error(e: float) -> float:
    """The bound used for integers: whole, 0.5 meaning lossless."""
    return max(0.5, float(int(e)))


def quantum(z: Column, low: Column, error: float) -> Column:
    """floor((z - low) / (2 e) + 0.5), by the reciprocal as the format prescribes."""
    return F.floor((z - low) * F.lit(1.0 / (2.0 * error)) + 0.5).cast("bigint")


def bit_width(q: Column) -> Column:
    return F.when(q <= 0, 0).otherwise(F.length(F.bin(q))).cast("bigint")


def block_ranges(px: DataFrame, size: int = 8) -> DataFrame:
    return with_blocks(valid(px), size).groupBy(*BLOCK).agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def quantize(px: DataFrame, error: float, size: int = 8) -> DataFrame:
    """Every valid value with its block's offset ``z_min`` and quantum ``q``. The block minimum is a window over the block's
    key: one shuffle, and no join back."""
    w = W.partitionBy(*BLOCK)
    v = with_blocks(valid(px), size).withColumn("z_min", F.min("z").over(w))
    return v.select(*BLOCK, "row", "col", "z", "z_min", quantum(F.col("z"), F.col("z_min"), error).alias("q"))


def dequantize(q: DataFrame, ranges: DataFrame, error: float) -> DataFrame:
    """Values from quanta, never above the depth's maximum (``ranges``: one row a band and depth; Spark broadcasts it
    where it is small)."""
    r = ranges.select("band", "depth", F.col("z_max").alias("top"))
    return q.join(r, ["band", "depth"]).withColumn("y", F.least(F.col("z_min") + F.col("q") * F.lit(2.0 * error), "top")).drop("top")


def quantize_error_blocks(px: DataFrame, error: float, size: int = 8) -> DataFrame:
    """The flagship: quantise, reconstruct, and report each block's range, largest quantum and largest error."""
    y = dequantize(quantize(px, error, size), data_ranges(px), error)
    return y.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.min("z_min").alias("z_min"), F.max("q").alias("max_q"), F.max(F.abs(F.col("z") - F.col("y"))).alias("max_error"))


def raise_error(px: DataFrame, error: float) -> DataFrame:
    """The coarsest rounding step at which all values are multiples up to error / 2: its half is the bound to use (the given one if no step is)."""
    steps = F.array(*[F.lit(s) for s in ROUND_STEPS])
    v = valid(px).select("band", "z", F.explode(steps).alias("step")).filter(F.col("step") / 2 > error)
    x = F.col("z") / F.col("step")
    r = v.groupBy("band", "step").agg(F.max(F.abs(F.floor(x + 0.5) - x) * F.col("step")).alias("rest"))
    best = r.groupBy("band").agg(F.max(F.when(F.col("rest") <= F.lit(error) / 2, F.col("step"))).alias("step"))
    every = valid(px).groupBy("band").agg(F.count("*").alias("n"))
    return every.join(best, "band", "left").select("band", "n", F.coalesce(F.col("step") / 2, F.lit(error)).alias("max_error"))


def depth_delta(px: DataFrame) -> DataFrame:
    w = W.partitionBy("band", "row", "col").orderBy("depth")
    return px.select("band", "row", "col", "depth", (F.col("z") - F.coalesce(F.lag("z").over(w), F.lit(0.0))).alias("delta"))


def depth_delta_float(px: DataFrame, error: float) -> DataFrame:
    """Depth differences kept as 32-bit floats, and per band whether rounding them stays within error / 8."""
    w = W.partitionBy("band", "row", "col").orderBy("depth")
    d = px.withColumn("p", F.lag("z").over(w)).filter("p is not null").withColumn("d", F.col("z") - F.col("p"))
    lost = F.abs(F.col("d").cast("float").cast("double") + F.col("p") - F.col("z"))
    return d.groupBy("band", "depth").agg(F.max(lost).alias("lost"), (F.max(lost) <= F.lit(error) / 8).alias("usable"))


def row_derivative(px: DataFrame, level: int = 1) -> DataFrame:
    """First differences along rows, ``level`` times (the first ``level`` values of a row keep what they were)."""
    w = W.partitionBy("band", "depth", "row").orderBy("col")
    out = px.select("band", "row", "col", "depth", "z")
    for k in range(level):
        out = out.withColumn("p", F.lag("z").over(w)).withColumn("z", F.when(F.col("col") > k, F.col("z") - F.col("p")).otherwise(F.col("z"))).drop("p")
    return out.withColumnRenamed("z", "d")


def cross_derivative(px: DataFrame) -> DataFrame:
    """Row differences, then differences of these along columns."""
    rows, cols = in_stripe("row", "col"), in_stripe("col", "row")
    x = striped(px.select("band", "row", "col", "depth", "z"))
    x = x.withColumn("d", F.col("z") - F.coalesce(F.lag("z").over(rows), F.lit(0.0)))
    return x.withColumn("d", F.col("d") - F.coalesce(F.lag("d").over(cols), F.lit(0.0))).filter("not halo").select("band", "row", "col", "depth", "d")


def restore(d: DataFrame, cross: bool = False) -> DataFrame:
    """Values from differences: prefix sums along rows, and (for cross differences) along columns. The latter are taken within stripes, where both kinds of sum share one shuffle of the
    pixels; a stripe gets its columns' sums of the stripes before as one row."""
    rows = W.partitionBy("band", "depth", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    if not cross:
        return d.select("band", "row", "col", "depth", F.sum("d").over(rows).alias("z"))
    keys = ["band", "depth", "stripe"]
    s = d.withColumn("stripe", F.floor(F.col("row") / STRIPE).cast("bigint")).repartition(*keys)
    s = s.withColumn("z", F.sum("d").over(in_stripe("row", "col").rowsBetween(W.unboundedPreceding, 0)))
    s = s.select(*keys, "row", "col", F.sum("z").over(in_stripe("col", "row").rowsBetween(W.unboundedPreceding, 0)).alias("z"))
    ends = s.groupBy(*keys, "col").agg(F.max_by("z", "row").alias("t"))
    before = W.partitionBy("band", "depth", "col").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("t", F.sum("t").over(before)).filter("t is not null")
    carried = ends.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", "t"))).alias("carried"))
    return s.join(carried, keys, "left").select("band", "row", "col", "depth", (F.col("z") + F.coalesce(F.col("carried")[F.col("col")], F.lit(0.0))).alias("z"))


def byte_planes(px: DataFrame, n: int = 4) -> DataFrame:
    """The bytes of integer values as planes, least significant first."""
    v = F.col("z").cast("bigint")
    planes = F.array(*[F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)) for k in range(n)])
    return px.select("band", "row", "col", "depth", F.posexplode(planes).alias("plane", "byte")).withColumn("plane", F.col("plane").cast("bigint"))


def byte_derivative(px: DataFrame, level: int = 1) -> DataFrame:
    """Wrap-around differences of 8-bit values in row order, ``level`` times."""
    d = row_derivative(px, level)
    return d.select("band", "row", "col", "depth", F.pmod(F.col("d").cast("bigint"), F.lit(256)).alias("byte"))


def interleave_swap(px: DataFrame, width: int, depth: int) -> DataFrame:
    """Positions of each value pixel-interleaved (p * depth + d) and band-sequential (d * pixels + p), with as many pixels as the
    rows of ``px`` have."""
    p = F.col("row") * width + F.col("col")
    # one row: a broadcast of proven size
    size = F.broadcast(px.agg(((F.max("row") + 1) * width).alias("pixels")))
    return px.crossJoin(size).select((p * depth + F.col("depth")).alias("bip"), (F.col("depth") * F.col("pixels") + p).alias("bsq"), "z")


def round_half_up(px: DataFrame) -> DataFrame:
    return px.select("band", "row", "col", "depth", F.floor(F.col("z") + 0.5).cast("bigint").alias("v"))


def fill_constant(px: DataFrame) -> DataFrame:
    """What a decoder gives for a raster reduced to its per-depth minima: the minimum where valid, else 0."""
    r = data_ranges(px).select("band", "depth", "z_min")
    return px.join(r, ["band", "depth"], "left").select("band", "row", "col", "depth", F.when(F.col("valid"), F.col("z_min")).otherwise(0.0).alias("z"))
