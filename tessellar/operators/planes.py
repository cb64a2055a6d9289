"""Float values as integer fields: byte planes, field-wise differences, and the choices made from samples of them, all as columns.

SQL has no cast from a float to its bits, so exponent, sign and mantissa are taken by exact arithmetic (powers of two and differences that
doubles hold exactly). A value is a high field (32-bit floats: exponent, then sign; doubles: sign, then exponent) and a low one (the
mantissa); differences wrap within each field.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .statistics import STRIPE, in_stripe, striped

#: Mantissa bits, exponent bits, bytes.
KINDS = {"float": (23, 8, 4), "double": (52, 11, 8)}
#: Fixed values of the format's sampling: values of a sample, every how many of them are counted, the most differences of a plane, the least rows of a stripe.
SAMPLE, STEP, MOST, LEAST_ROWS = 8192, 7, 5, 4
#: Sampled rows (some numbers each) that are broadcast at most; their number grows as the square root of a band's size.
FEW_ROWS = 500_000


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def with_fields(px: DataFrame, kind: str) -> DataFrame:
    """``px`` with ``hi`` and ``lo``, the fields of the value ``z`` as a ``kind`` (which must hold it exactly)."""
    mantissa, width, _ = KINDS[kind]
    bias = (1 << width - 1) - 1
    a = F.abs("z")
    guess = F.floor(F.log2(F.when(a < float("inf"), a)))
    x = px.withColumn("_e", guess)
    x = x.withColumn("_e", F.col("_e") - (_power(F.col("_e")) > a).cast("bigint") + (_power(F.col("_e") + 1) <= a).cast("bigint"))  # a logarithm can be off at a power of two
    sign = ((F.col("z") < 0) | ((F.col("z") == 0) & F.col("z").cast("string").startswith("-"))).cast("bigint")
    odd, zero, small = F.isnan("z") | (a == float("inf")), F.col("z") == 0, F.col("_e") < 1 - bias
    half = 2.0 ** ((mantissa + bias - 1) // 2)
    rest = (mantissa + bias - 1) % 2 + 1
    tiny = a * half * half * rest  # subnormal: in units of the smallest one
    exponent = F.when(odd, F.lit((1 << width) - 1)).when(zero | small, F.lit(0)).otherwise(F.col("_e") + bias).cast("bigint")
    low = F.when(F.isnan("z"), F.lit(float(1 << mantissa - 1))).when(odd | zero, F.lit(0.0)).when(small, tiny).otherwise((a / _power(F.col("_e")) - 1) * float(1 << mantissa))
    high = exponent * 2 + sign if kind == "float" else sign * (1 << width) + exponent
    return x.withColumn("hi", F.when(F.isnan("z"), exponent * 2 if kind == "float" else exponent).otherwise(high)).withColumn("lo", low.cast("bigint")).drop("_e")


def value_of(hi: Column, lo: Column, kind: str) -> Column:
    """The value of both fields, as a double."""
    mantissa, width, _ = KINDS[kind]
    bias, top = (1 << width - 1) - 1, (1 << width) - 1
    sign, e = (hi % 2, F.floor(hi / 2)) if kind == "float" else (F.floor(hi / (1 << width)), hi % (1 << width))
    part = lo / F.lit(float(1 << mantissa))
    half = 2.0 ** -((bias - 1) // 2)
    tiny = part * half * half * 2.0 ** -((bias - 1) % 2)
    size = F.when(e == top, F.when(lo == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(e == 0, tiny).otherwise((part + 1) * _power(e - bias))
    return F.when(sign == 1, -size).otherwise(size)


def packed(hi: Column, lo: Column, kind: str) -> Column:
    """Both fields in one integer (for doubles its sign bit is the value's)."""
    return F.shiftleft(hi, KINDS[kind][0]).bitwiseOR(lo)


def byte_of(u: Column, plane: int) -> Column:
    return F.shiftrightunsigned(u, 8 * plane).bitwiseAND(F.lit(255))


def _less(x: Column, before: Column, bits: int) -> Column:
    return F.pmod(x - F.coalesce(before, F.lit(0)), F.lit(1 << bits))


def with_differences(x: DataFrame, kind: str, rows: W, cols: W) -> DataFrame:
    """``x`` (hi, lo) with packed integers ``u0`` (as they are), ``u1`` (less the left neighbour) and ``u2`` (then less the one above); the first column keeps its
    values and so does the first row. ``rows``, ``cols``: windows along them, which must begin at the raster's edge or a row before what is wanted."""
    mantissa, width, _ = KINDS[kind]
    fields = (("hi", width + 1), ("lo", mantissa))
    for name, bits in fields:
        x = x.withColumn(f"{name}1", _less(F.col(name), F.lag(name).over(rows), bits))
    for name, bits in fields:
        x = x.withColumn(f"{name}2", _less(F.col(f"{name}1"), F.lag(f"{name}1").over(cols), bits))
    for k, end in enumerate(("", "1", "2")):
        x = x.withColumn(f"u{k}", packed(F.col(f"hi{end}"), F.col(f"lo{end}"), kind))
    return x


def field_differences(px: DataFrame, kind: str) -> DataFrame:
    """Every value's fields and their differences, by stripes of rows with the row above each."""
    x = with_differences(with_fields(striped(px.select("band", "row", "col", "depth", "z")), kind), kind, in_stripe("row", "col"), in_stripe("col", "row"))
    return x.filter("not halo").select("band", "row", "col", "depth", "hi", "lo", "hi1", "lo1", "hi2", "lo2", "u0", "u1", "u2")


def restored(d: DataFrame, kind: str) -> DataFrame:
    """Values from the cross differences ``hi2``, ``lo2``: each field's running sums along columns (a stripe at a time, with the sums of the stripes before), then along rows,
    modulo the field. Sums are decimals, which no number of rows overflows."""
    mantissa, width, _ = KINDS[kind]
    fields = (("hi", width + 1), ("lo", mantissa))
    wrap = lambda c, bits: F.pmod(c, F.lit(1 << bits).cast("decimal(20,0)"))
    keys = ["band", "depth", "stripe", "col"]
    s = d.select("band", "row", "col", "depth", F.floor(F.col("row") / STRIPE).cast("bigint").alias("stripe"), *[F.col(f"{n}2").cast("decimal(20,0)").alias(n) for n, _ in fields])
    before = W.partitionBy("band", "depth", "col").orderBy("stripe").rowsBetween(W.unboundedPreceding, -1)
    totals = s.groupBy(*keys).agg(*[F.sum(n).alias(f"{n}_t") for n, _ in fields])
    totals = totals.select(*keys, *[F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_t") for n, _ in fields])
    down = W.partitionBy(*keys).orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    s = s.select("band", "row", "depth", "stripe", "col", *[F.sum(n).over(down).alias(n) for n, _ in fields]).join(totals, keys)
    s = s.select("band", "row", "col", "depth", *[wrap(F.col(n) + F.col(f"{n}_t"), b).alias(n) for n, b in fields])
    along = W.partitionBy("band", "depth", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    s = s.select("band", "row", "col", "depth", *[wrap(F.sum(n).over(along), b).cast("bigint").alias(n) for n, b in fields])
    return s.select("band", "row", "col", "depth", value_of(F.col("hi"), F.col("lo"), kind).alias("z"))


# ---------------------------------------------------------------- samples


def shapes(px: DataFrame) -> DataFrame:
    """band, height, width: a row a band."""
    return px.groupBy("band").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def _count(values: Column) -> Column:
    """How many samples so many values get: about the square root of the samples they would fill."""
    return F.round(F.sqrt(F.round(values / SAMPLE) + 1)).cast("bigint")


def _spread(shape: DataFrame, length: Column, size: Column) -> DataFrame:
    """``shape`` with one row for each of its ``count`` samples of ``length`` among ``size``: ``at``, where it begins. In 32-bit floats, as the format's encoder places them."""
    f = lambda c: c.cast("float")
    x = shape.withColumn("_margin", f((size - F.col("count") * length) / (F.lit(2.0) * F.col("count"))))
    x = x.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("part"))
    step = f(f(F.lit(2.0)) * F.col("_margin") + f(length))
    return x.withColumn("at", F.greatest(F.lit(0), (F.col("_margin") + step * f(F.col("part"))).cast("bigint"))).drop("_margin")


def stripes_of(shape: DataFrame) -> DataFrame:
    """band, width, part, begin, end: the rows (about ``SAMPLE`` values) on which predictors are tried, as stretches of scan positions."""
    rows = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(SAMPLE) / F.col("width"))).cast("bigint")
    x = shape.withColumn("rows", rows).withColumn("count", F.greatest(F.lit(1), F.least(_count(F.col("height") * F.col("width")), F.floor(F.col("height") / F.col("rows")))).cast("bigint"))
    x = _spread(x, F.col("rows"), F.col("height"))
    end = F.least(F.col("at") + F.col("rows"), F.col("height"))
    return x.select("band", "width", "part", (F.col("at") * F.col("width")).alias("begin"), (end * F.col("width")).alias("end")).filter("begin < end")


def snippets_of(shape: DataFrame) -> DataFrame:
    """The same for the stretches of a byte plane on which its differences are tried; none where the plane has fewer than ``SAMPLE`` bytes."""
    size = F.col("height") * F.col("width")
    x = shape.withColumn("count", F.least(_count(size), F.floor(size / SAMPLE)).cast("bigint")).filter("count > 0")
    x = _spread(x, F.lit(SAMPLE), size)
    return x.select("band", "width", "part", F.col("at").alias("begin"), F.least(F.col("at") + SAMPLE, size).alias("end"))


def sampled(px: DataFrame, parts: DataFrame, kind: str) -> DataFrame:
    """band, part, p (position in the part), u0, u1, u2 of the values in ``parts``. Only their rows, and the row above each, go through the shuffle: parts are expanded to rows
    and joined by band and row (broadcast where they are few, which is counted first); a part is a stretch of about ``SAMPLE`` values (of ``LEAST_ROWS`` rows where these are wider)."""
    first, last = F.floor(F.col("begin") / F.col("width")), F.floor((F.col("end") - 1) / F.col("width"))
    rows = parts.select("*", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last)).alias("row"))
    few = rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    x = with_fields(px.select("band", "row", "col", "z").join(F.broadcast(rows) if few else rows, ["band", "row"]), kind).repartition("band", "part")
    x = with_differences(x, kind, W.partitionBy("band", "part", "row").orderBy("col"), W.partitionBy("band", "part", "col").orderBy("row"))
    p = F.col("row") * F.col("width") + F.col("col") - F.col("begin")
    return x.withColumn("p", p).filter((F.col("p") >= 0) & (F.col("p") < F.col("end") - F.col("begin"))).select("band", "part", "p", "u0", "u1", "u2")


def _entropy_bytes(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bytes: the entropy of bytes counted as (keys, byte), in whole bytes, rounded up."""
    g = counted.groupBy(*keys, "byte").agg(F.count("*").alias("n"))
    g = g.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))  # sum of n log(t / n)
    return g.select(*keys, F.floor((F.round(F.col("t") * F.log2("t") - F.col("s"), 6) + 7) / 8).cast("bigint").alias("bytes"))


def predictors(px: DataFrame, kind: str) -> DataFrame:
    """band, as_is, along_rows, along_both, predictor (0, 1, 2): the estimated bytes of the sampled stripes' byte planes without differences, with those along rows, and along
    rows and columns, each plane with or without a byte difference (at the counted places), whichever is less; and the first predictor of the least."""
    x = sampled(px, stripes_of(shapes(px)), kind)
    scan = W.partitionBy("band", "part").orderBy("p")
    for k in range(3):
        x = x.withColumn(f"b{k}", F.lag(f"u{k}").over(scan))
    size = KINDS[kind][2]
    cases = []
    for k in range(3):
        for plane in range(size):
            own, before = byte_of(F.col(f"u{k}"), plane), byte_of(F.col(f"b{k}"), plane)
            for less in (0, 1):
                byte = F.when(F.col("p") == 0, own).otherwise(F.pmod(own - before, F.lit(256))) if less else own
                cases.append(F.struct(F.lit(k).alias("predictor"), F.lit(plane).alias("plane"), F.lit(less).alias("less"), byte.cast("int").alias("byte")))
    x = x.filter(F.col("p") % STEP == 0).select("band", "part", F.inline(F.array(*cases)))
    least = _entropy_bytes(x, ["band", "part", "predictor", "plane", "less"]).groupBy("band", "part", "predictor", "plane").agg(F.min("bytes").alias("bytes"))
    per = [F.coalesce(F.sum(F.when(F.col("predictor") == k, F.col("bytes"))), F.lit(0)).alias(n) for k, n in enumerate(("as_is", "along_rows", "along_both"))]
    best = F.when((F.col("as_is") <= F.col("along_rows")) & (F.col("as_is") <= F.col("along_both")), 0).when(F.col("along_rows") <= F.col("along_both"), 1).otherwise(2)
    return least.groupBy("band").agg(*per).withColumn("predictor", best.cast("bigint"))


def plane_levels(px: DataFrame, kind: str, chosen: DataFrame | None = None) -> DataFrame:
    """band, predictor, plane, level, bytes, best: for each byte plane after the band's predictor the estimated bytes with 0, 1, ... byte differences (``MOST`` together with the
    predictor's at most), and the level at which the first one more doesn't help. Planes too small to sample stay at level 0."""
    size = KINDS[kind][2]
    chosen = (predictors(px, kind) if chosen is None else chosen).select("band", "predictor")
    x = sampled(px, snippets_of(shapes(px)), kind).join(chosen, "band")
    x = x.select("band", "part", "p", "predictor", F.get(F.array("u0", "u1", "u2"), F.col("predictor").cast("int")).alias("u"))
    scan = W.partitionBy("band", "part").orderBy("p")
    x = x.select("*", *[F.lag("u", j).over(scan).alias(f"l{j}") for j in range(1, MOST + 1)]).withColumn("l0", F.col("u"))
    cases = []
    for plane in range(size):
        bytes_ = [byte_of(F.col(f"l{j}"), plane) for j in range(MOST + 1)]
        for level in range(MOST + 1):
            terms = [bytes_[j] * ((-1) ** j * comb(level, j)) for j in range(level + 1)]
            value = sum(terms[1:], terms[0])
            byte = F.when(F.col("p") == 0, bytes_[0]).otherwise(F.pmod(value, F.lit(256))) if level else value
            cases.append(F.struct(F.lit(plane).cast("bigint").alias("plane"), F.lit(level).cast("bigint").alias("level"), byte.cast("int").alias("byte")))
    x = x.filter(F.col("p") % STEP == 0).select("band", "part", "predictor", F.inline(F.array(*cases))).filter(F.col("level") <= MOST - F.col("predictor"))
    costs = _entropy_bytes(x, ["band", "part", "plane", "level"]).groupBy("band", "plane", "level").agg(F.sum("bytes").alias("bytes"))
    every = chosen.select("band", "predictor", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(size)])).alias("plane"))
    costs = every.join(costs, ["band", "plane"], "left").fillna(0, ["level", "bytes"])
    w = W.partitionBy("band", "plane")
    more = F.lead("bytes").over(w.orderBy("level"))
    costs = costs.withColumn("stop", more.isNull() | (more >= F.col("bytes")))
    return costs.select("band", "predictor", "plane", "level", "bytes", F.min(F.when(F.col("stop"), F.col("level"))).over(w).alias("best"))
