"""Encoding costs and choices of the tile codec, as aggregates over blocks: what would be written, without writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .statistics import BLOCK, histogram, spread, valid, with_blocks
from .transforms import MAX_QUANTUM, bit_width, block_ranges, quantize, quantum


def bytes_for_count(n: Column) -> Column:
    return F.when(n < 256, 1).when(n < 65536, 2).otherwise(4)


def offset_bytes(z: Column, kind: str) -> Column:
    """Size of the smallest type that holds the block's offset exactly."""
    whole = z == F.floor(z)
    inside = lambda lo, hi: whole & z.between(F.lit(float(lo)), F.lit(float(hi)))
    if kind == "float":
        return F.when(inside(0, 255), 1).when(inside(-32768, 32767), 2).otherwise(4)
    if kind == "double":
        return F.when(inside(-32768, 32767), 2).when(inside(-2147483648, 2147483647), 4).when(z.cast("float").cast("double") == z, 4).otherwise(8)
    if kind == "int":
        return F.when(inside(0, 255), 1).when(inside(-32768, 65535), 2).otherwise(4)
    if kind == "uchar":
        return F.lit(1)
    raise ValueError(kind)


SIZES = {"uchar": 1, "int": 4, "float": 4, "double": 8}


def stuffed_bytes(n: Column, q: Column) -> Column:
    """Bit stuffing without a dictionary: head, count and n values of the width of the largest one."""
    return (1 + bytes_for_count(n) + F.floor((n * bit_width(q) + 7) / 8)).cast("bigint")


def lut_bytes(n: Column, q: Column, distinct: Column) -> Column:
    """With a dictionary of the ``distinct`` values (0 isn't stored) and indexes into it."""
    d = distinct - 1
    return (2 + bytes_for_count(n) + F.floor((d * bit_width(q) + 7) / 8) + F.floor((n * bit_width(d) + 7) / 8)).cast("bigint")


def tile_costs(px: DataFrame, error: float, kind: str, size: int = 8, lut: bool = True, keys: list[str] = BLOCK, first: float | None = None) -> DataFrame:
    """Per block: mode (zero, constant, raw, stuffed or lut) and bytes. One shuffle, on the block (none if ``px`` is already
    partitioned by some of ``keys``); ranges, quanta and equal neighbours come from windows on it, the rest from one aggregate.
    With an ``error`` of 0 nothing is quantised: a block of different values is raw. ``first``: what a block's first value counts as the same as."""
    w = W.partitionBy(*keys)
    v = valid(px) if {"bi", "bj"} <= set(px.columns) else spread(with_blocks(valid(px), size), *keys)
    v = v.withColumn("lo", F.min("z").over(w)).withColumn("same", (F.col("z") == F.lag("z", 1, first).over(w.orderBy("row", "col"))).cast("bigint"))
    n, lo, hi = F.col("n"), F.col("z_min"), F.col("z_max")
    # a block has size * size values at most: its set of quanta is as small
    rows = v.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_same"),
        F.size(F.collect_set(quantum(F.col("z"), F.col("lo"), error) if error else F.lit(0))).cast("bigint").alias("distinct"),
    )
    raw = 1 + n * SIZES[kind]
    top = (hi - lo) * F.lit(1.0 / (2.0 * error)) if error else F.when(hi > lo, F.lit(2.0 * MAX_QUANTUM[SIZES[kind]])).otherwise(F.lit(0.0))
    q = F.floor(top + 0.5).cast("bigint")
    base = 1 + offset_bytes(lo, kind)
    simple = stuffed_bytes(n, q)
    try_lut = (n > 4) & (hi > lo + 3 * error) & (2 * F.col("n_same") > n) & (F.col("distinct") < 256)
    use = try_lut & (lut_bytes(n, q, F.col("distinct")) < simple) if lut else F.lit(False)
    packed = base + F.when(q > 0, F.when(use, lut_bytes(n, q, F.col("distinct"))).otherwise(simple)).otherwise(0)
    zero, too_wide = (lo == 0) & (hi == 0), top > MAX_QUANTUM[SIZES[kind]]
    mode = F.when(zero, "zero").when(too_wide | (packed >= raw), "raw").when(q == 0, "constant").when(use, "lut").otherwise("stuffed")
    size_ = F.when(zero, 1).when(too_wide | (packed >= raw), raw).otherwise(packed)
    return rows.select(*keys, "n", mode.alias("mode"), size_.cast("bigint").alias("bytes"))


def depth_costs(px: DataFrame, kind: str, size: int = 8) -> DataFrame:
    """band, depth, bi, bj, n, mode, differs, bytes of every block of an integer raster without loss: as it is, or as 32-bit differences to the depth below where these take fewer bytes (not in
    the first depth, and not in a block with a difference beyond 32 bits). One shuffle brings all depths of a block together; both costs come from it."""
    x = spread(with_blocks(valid(px), size), "band", "bi", "bj")
    x = x.withColumn("d", F.col("z") - F.lag("z").over(W.partitionBy("band", "bi", "bj", "row", "col").orderBy("depth")))
    plain = tile_costs(x.drop("d"), 0.5, kind, size, keys=["band", "bi", "bj", "depth"])
    block = W.partitionBy("band", "bi", "bj", "depth")
    fits = F.bool_and(F.col("d").between(F.lit(-2147483648.0), F.lit(2147483647.0))).over(block)
    other = x.filter("d is not null").withColumn("fits", fits).filter("fits").select("band", "bi", "bj", "depth", "row", "col", F.col("d").alias("z"), "valid")
    less = tile_costs(other, 0.5, "int", size, keys=["band", "bi", "bj", "depth"], first=0.0)
    both = plain.withColumn("differs", F.lit(False)).unionByName(less.withColumn("differs", F.lit(True)))
    best = both.groupBy(*BLOCK).agg(F.min_by(F.struct("n", "mode", "differs", "bytes"), F.struct("bytes", "differs")).alias("b"))
    return best.select(*BLOCK, "b.*")


def tile_cost_total(px: DataFrame, error: float, kind: str, size: int = 8) -> DataFrame:
    return tile_costs(px, error, kind, size).groupBy("band", "mode").agg(F.count("*").alias("n_blocks"), F.sum("bytes").cast("bigint").alias("bytes"))


def block_size_choice(px: DataFrame, error: float, kind: str) -> DataFrame:
    """Bytes of both block sizes; 16 wins ties. Pixels are shuffled once, by the large block, which holds whole small ones."""
    large = [F.floor(F.col(c) / 16).cast("bigint").alias(k) for c, k in (("row", "bi16"), ("col", "bj16"))]
    x = spread(with_blocks(valid(px), 8).select("*", *large), "band", "depth", "bi16", "bj16")
    small = tile_costs(x, error, kind, 8, keys=["band", "depth", "bi16", "bj16", "bi", "bj"]).groupBy("band").agg(F.sum("bytes").cast("bigint").alias("bytes_8"))
    wide = tile_costs(x, error, kind, 16, keys=["band", "depth", "bi16", "bj16"]).groupBy("band").agg(F.sum("bytes").cast("bigint").alias("bytes_16"))
    return small.join(wide, "band").withColumn("block", F.when(F.col("bytes_16") <= F.col("bytes_8"), 16).otherwise(8).cast("bigint"))


def block_quant_bits(px: DataFrame, error: float, size: int = 8) -> DataFrame:
    r = block_ranges(px, size)
    top = (F.col("z_max") - F.col("z_min")) * F.lit(1.0 / (2.0 * error))
    return r.select(*BLOCK, "n", F.floor(top + 0.5).cast("bigint").alias("max_q"), bit_width(F.floor(top + 0.5).cast("bigint")).alias("bits"))


def lut_index(px: DataFrame, error: float, size: int = 8) -> DataFrame:
    """Each value's index into its block's sorted dictionary."""
    w = W.partitionBy(*BLOCK).orderBy("q")
    return quantize(px, error, size).select(*BLOCK, "row", "col", "q", (F.dense_rank().over(w) - 1).cast("bigint").alias("lut_index"))


def rle_runs(px: DataFrame, width: int) -> DataFrame:
    """Runs of equal values in scan order within a row: start, length and value (gaps and islands)."""
    w = W.partitionBy("band", "depth", "row").orderBy("col")
    new = valid(px).withColumn("new", F.coalesce((F.col("z") != F.lag("z").over(w)) | (F.col("col") != F.lag("col").over(w) + 1), F.lit(True)).cast("bigint"))
    runs = new.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("band", "depth", "row", "run").agg(F.min("col").alias("start"), F.count("*").alias("length"), F.min("z").alias("z")).drop("run")


def code_range(px: DataFrame) -> DataFrame:
    """The shortest circular stretch of the 256 bins that holds all used ones: start and length, by its complement, the longest gap."""
    h = histogram(px).filter("n > 0").select("band", "bin")
    w = W.partitionBy("band").orderBy("bin")
    nxt = h.withColumn("next", F.coalesce(F.lead("bin").over(w), F.min("bin").over(W.partitionBy("band")) + 256))
    gap = nxt.withColumn("gap", F.col("next") - F.col("bin"))
    best = gap.groupBy("band").agg(F.max(F.struct("gap", (-F.col("next")).alias("m"))).alias("b"))
    return best.select("band", F.pmod(-F.col("b.m"), F.lit(256)).alias("start"), (F.lit(257) - F.col("b.gap")).cast("bigint").alias("length"))


def block_distinct(px: DataFrame, error: float, size: int = 8) -> DataFrame:
    return quantize(px, error, size).groupBy(*BLOCK).agg((F.count_distinct("q") - 1).alias("changes"))
