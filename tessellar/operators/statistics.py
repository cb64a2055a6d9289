"""Statistics and ranges of pixel relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = ["band", "depth", "bi", "bj"]
#: Rows of a stripe: what needs the row above works stripe by stripe, each with the last row of the one before.
STRIPE = 64
#: About as many rows go into a task that sorts pixels; a row takes some 500 bytes in the sorts of a stage together.
TASK_ROWS = 250_000


def valid(px: DataFrame) -> DataFrame:
    return px.filter(F.col("valid"))


def data_ranges(px: DataFrame) -> DataFrame:
    """Per band and depth; two-level partial aggregation, so one row a task and group is shuffled."""
    return valid(px).groupBy("band", "depth").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def overall_range(px: DataFrame) -> DataFrame:
    """Ranges of every depth, band and the whole raster (null keys: all of them), by one rollup."""
    return valid(px).rollup("band", "depth").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("*").alias("n"))


def constant(px: DataFrame) -> DataFrame:
    r = data_ranges(px)
    return r.groupBy("band").agg(F.bool_and(F.col("z_min") == F.col("z_max")).alias("constant_depths"), (F.min("z_min") == F.max("z_max")).alias("constant_band"))


def with_blocks(px: DataFrame, size: int = 8) -> DataFrame:
    return px.withColumn("bi", F.floor(F.col("row") / size).cast("bigint")).withColumn("bj", F.floor(F.col("col") / size).cast("bigint"))


def spread(px: DataFrame, *keys: str, joined: bool = False) -> DataFrame:
    """``px`` partitioned by ``keys`` (those of blocks or stripes, so that there are many), in tasks of about ``TASK_ROWS`` rows at any size; rows are counted first. Left to
    itself Spark sizes tasks by compressed bytes, which say little about the memory that sorting such rows takes; it still does where its least number of tasks, one
    a core, is enough. ``joined``: there are no fewer tasks than the session's shuffles have, as a join on the keys would shuffle the pixels again otherwise."""
    spark = px.sparkSession
    n = -(-px.count() // TASK_ROWS)
    if n <= spark.sparkContext.defaultParallelism:
        return px.repartition(*keys)
    return px.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if joined else n, *keys)


def striped(px: DataFrame, rows: int = STRIPE) -> DataFrame:
    """``px`` with ``stripe`` and ``halo``: the last row of a stripe is also in the next one, as halo. One shuffle, on the stripe, serves all windows
    within it, along rows and columns, however wide or high the raster is."""
    stripe = F.floor(F.col("row") / rows).cast("bigint")
    places = F.when(F.col("row") % rows == rows - 1, F.array(F.struct(stripe.alias("stripe"), F.lit(False).alias("halo")), F.struct((stripe + 1).alias("stripe"), F.lit(True).alias("halo")))).otherwise(
        F.array(F.struct(stripe.alias("stripe"), F.lit(False).alias("halo")))
    )
    return spread(px.select("*", F.inline(places)), "band", "depth", "stripe", joined=True)


def in_stripe(*order: str):
    """The window along a stripe's rows ("row", "col"), columns ("col", "row") or all of it ("", "row", "col"): what it is cut by, then its order."""
    cut, *by = order
    return W.partitionBy("band", "depth", "stripe", *([cut] if cut else [])).orderBy(*by)


def block_stats(px: DataFrame, size: int = 8, error: float = 0.0) -> DataFrame:
    """Per block: n, range, how many values equal the one before (in scan order) and whether a dictionary is worth trying."""
    w = W.partitionBy(*BLOCK).orderBy("row", "col")
    v = with_blocks(valid(px), size).withColumn("same", (F.col("z") == F.lag("z").over(w)).cast("bigint"))
    g = v.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_same"))
    return g.withColumn("try_lut", (F.col("n") > 4) & (F.col("z_max") > F.col("z_min") + 3 * error) & (2 * F.col("n_same") > F.col("n")))


def find_data_range(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Range over all valid values; (-1, -1) if there is none."""
    v = valid(px) if nodata is None else valid(px).filter(F.col("z") != nodata)
    return v.agg(F.coalesce(F.min("z"), F.lit(-1.0)).alias("z_min"), F.coalesce(F.max("z"), F.lit(-1.0)).alias("z_max"))


def max_abs_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two rasters over values valid in both, and whether their masks agree."""
    keys = ["band", "row", "col", "depth"]
    j = a.select(*keys, "z", "valid").join(b.select(*keys, F.col("z").alias("y"), F.col("valid").alias("ok")), keys)
    both = F.col("valid") & F.col("ok")
    return j.groupBy("band").agg(F.max(F.when(both, F.abs(F.col("z") - F.col("y")))).alias("max_error"), F.count_if(F.col("valid") != F.col("ok")).alias("n_mask_diff"))


def band_stats(px: DataFrame) -> DataFrame:
    r = data_ranges(px)
    lists = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("depth", c))), lambda x: F.round(x[c] * 100).cast("bigint").cast("string")))
    return r.groupBy("band").agg(F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), lists("z_min").alias("depth_mins"), lists("z_max").alias("depth_maxs"))


def histogram(px: DataFrame) -> DataFrame:
    """Counts of 8-bit values."""
    return valid(px).groupBy("band", F.pmod(F.col("z").cast("bigint"), F.lit(256)).alias("bin")).agg(F.count("*").alias("n"))


def predicted_delta(px: DataFrame) -> DataFrame:
    """Difference to the left neighbour if that is valid, else to the one above, else to the last valid value in scan order (0 for the first)."""
    rows, cols, scan = in_stripe("row", "col"), in_stripe("col", "row"), in_stripe("", "row", "col")
    near = lambda w: F.when((F.lag("valid").over(w)) & (F.lag("place").over(w) == F.col("place") - 1), F.lag("z").over(w))
    x = striped(px)
    # along rows and in scan order the pixels are sorted alike, so these two stand together
    x = x.withColumn("place", F.col("col")).withColumn("l", near(rows))
    x = x.withColumn("before", F.last(F.when(F.col("valid"), F.col("z")), True).over(scan.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("place", F.col("row")).withColumn("a", near(cols)).drop("place")
    # the last valid value of the stripes before: a row for each stripe. Its place in the stripe is one number (columns are below 2^57): with a struct, Spark would sort all pixels of a
    # split for it, however large, instead of holding a row for each stripe
    at = F.pmod(F.col("row"), F.lit(STRIPE)) * (1 << 57) + F.col("col")
    last = F.max_by(F.when(F.col("valid"), F.col("z")), F.when(F.col("valid"), at))
    ends = px.groupBy("band", "depth", F.floor(F.col("row") / STRIPE).cast("bigint").alias("stripe")).agg(last.alias("end"))
    earlier = W.partitionBy("band", "depth").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("band", "depth", "stripe", F.last("end", True).over(earlier).alias("end"))
    found = valid(x).filter("not halo").join(ends, ["band", "depth", "stripe"])
    return found.withColumn("delta", F.col("z") - F.coalesce("l", "a", "before", "end", F.lit(0.0)))


def delta_histogram(px: DataFrame) -> DataFrame:
    return predicted_delta(px).groupBy("band", F.pmod(F.col("delta").cast("bigint"), F.lit(256)).alias("bin")).agg(F.count("*").alias("n"))


def byte_histogram(px: DataFrame) -> DataFrame:
    """Counts of the bytes of 32-bit integers, for each of the four byte planes, and how many different bytes a plane has."""
    planes = px.select("band", F.posexplode(F.array(*[F.shiftright(F.col("z").cast("bigint"), 8 * k).bitwiseAND(F.lit(255)) for k in range(4)])).alias("plane", "byte"))
    return planes.groupBy("band", F.col("plane").cast("bigint").alias("plane"), F.col("byte").cast("bigint").alias("byte")).agg(F.count("*").alias("n"))


def entropy_bytes(px: DataFrame, width: int, step: int = 7, delta: bool = False) -> DataFrame:
    """Estimated size in bytes of 8-bit values by the entropy of every ``step``-th of them (or of its difference to the one on its left)."""
    k = F.col("row") * width + F.col("col")
    v = F.col("z").cast("bigint")
    if delta:
        v = v - F.coalesce(F.lag(v).over(W.partitionBy("band", "row").orderBy("col")), F.lit(0))
    s = px.withColumn("b", F.pmod(v, F.lit(256))).filter(k % step == 0).groupBy("band", "b").agg(F.count("*").alias("n"))
    t = s.groupBy("band").agg(F.sum("n").alias("total"))
    bits = F.sum(F.col("n") * F.log2(F.col("total") / F.col("n")))
    return s.join(t, "band").groupBy("band").agg(F.ceil(bits / 8 - 1e-9).cast("bigint").alias("bytes"), F.max("total").alias("n"))


def neighbour_pairs(px: DataFrame) -> DataFrame:
    """band, depth, x: the differing bits of every valid pixel and its valid left or upper neighbour. In a band of one depth without invalid pixels, as the
    format has it, no pair starts in the last row or column."""
    v = px.withColumn("v", F.col("z").cast("bigint"))
    rows, cols = in_stripe("row", "col"), in_stripe("col", "row")
    other = lambda w, place: F.when(F.lag("valid").over(w) & (F.lag(place).over(w) == F.col(place) - 1), F.lag("v").over(w))
    x = striped(v).withColumn("left", other(rows, "col")).withColumn("above", other(cols, "row")).filter("valid and not halo")
    size = px.groupBy("band").agg(((F.count_if(~F.col("valid")) == 0) & (F.max("depth") == 0)).alias("plain"), F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    x = x.join(size, "band")
    left = F.when(~F.col("plain") | (F.col("row") < F.col("last_row")), F.col("v").bitwiseXOR(F.col("left")))
    above = F.when(~F.col("plain") | (F.col("col") < F.col("last_col")), F.col("v").bitwiseXOR(F.col("above")))
    return x.select("band", "depth", F.explode(F.array(left, above)).alias("x")).filter("x is not null")


def bitplane_counts(px: DataFrame, bits: int = 8) -> DataFrame:
    """For each bit how many pairs of valid neighbours there are and how many differ in it."""
    per = [F.sum(F.shiftright("x", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(bits)]
    g = neighbour_pairs(px).groupBy("band", "depth").agg(F.count("*").alias("n_pairs"), *per)
    planes = g.select("band", "depth", "n_pairs", F.posexplode(F.array(*[f"b{k}" for k in range(bits)])).alias("bit", "n_diff"))
    return planes.select("band", "depth", F.col("bit").cast("bigint").alias("bit"), "n_pairs", F.col("n_diff").cast("bigint").alias("n_diff"))


def bitplane_noise_cut(px: DataFrame, eps: float = 0.01, bits: int = 8, least: int = 5000) -> DataFrame:
    """The error bound that drops the low bits which look like noise (differ in about half of all pairs, in every depth): from the highest
    plane that is noise together with the one below it, or else the lowest that is; none with fewer than ``least`` valid pixels or pairs."""
    c = bitplane_counts(px, bits).groupBy("band", "bit").agg(F.bool_and(F.abs(1 - 2 * F.col("n_diff") / F.col("n_pairs")) < eps).alias("noise"), F.max("n_pairs").alias("n_pairs"))
    c = c.withColumn("below", F.lag("noise").over(W.partitionBy("band").orderBy("bit")))
    found = c.groupBy("band").agg(F.max(F.when(F.col("noise") & F.col("below"), F.col("bit"))).alias("two"), F.min(F.when(F.col("noise"), F.col("bit"))).alias("one"), F.max("n_pairs").alias("n_pairs"))
    pixels = px.filter("depth = 0").groupBy("band").agg(F.count_if("valid").alias("n_valid"))
    cut = F.when((F.col("n_pairs") < least) | (F.col("n_valid") < least), F.lit(0)).otherwise(F.coalesce("two", "one", F.lit(0)))
    return found.join(pixels, "band").select("band", cut.cast("bigint").alias("planes"), F.floor(F.pow(F.lit(2.0), cut) / 2).cast("bigint").alias("max_error"))
