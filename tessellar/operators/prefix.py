"""Prefix codes of byte histograms as relations: code lengths, canonical codes, and the bytes that coded data would take.

A group (a band, a byte plane of it) has 256 bins at most, whatever the number of its pixels, so its sorted histogram is one small array.
Lengths come from the two-queue merge: leaves wait in order of count, merged nodes in order of birth, and the lighter head goes first (a leaf
where they weigh the same, which keeps the longest code short). Both queues only move forward, so the state of the fold is a few arrays that
only grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .costs import stuffed_bytes

#: Longest code that decoders read.
LONGEST = 32


def left(x: Column, bits: Column) -> Column:
    """``x`` shifted left by a column of bits."""
    return F.call_function("shiftleft", x, bits.cast("int"))


def right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits.cast("int"))


def byte_histogram(px: DataFrame, keys: list[str], byte: Column) -> DataFrame:
    """keys, bin, n: how often each byte occurs; added up in each task first."""
    return px.groupBy(*keys, byte.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def _merged(leaves: Column) -> Column:
    """The steps (0, 1, ...) at which each leaf and each merged node goes into a new node, as arrays ``leaf`` and ``node``."""
    m = F.size(leaves)
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("leaf"), none.alias("node"), F.array().cast("array<bigint>").alias("weight"), F.lit(0).cast("bigint").alias("held"))

    def take(s: Column, k: Column) -> Column:
        i, j = F.size(s["leaf"]), F.size(s["node"])
        ours, theirs = F.get(leaves, i)["n"], F.get(s["weight"], j)
        is_leaf = ours.isNotNull() & (theirs.isNull() | (ours <= theirs))
        w, step, second = F.when(is_leaf, ours).otherwise(theirs), F.shiftright(k, 1), k % 2 == 1
        return F.struct(
            F.when(is_leaf, F.array_append(s["leaf"], step)).otherwise(s["leaf"]).alias("leaf"),
            F.when(is_leaf, s["node"]).otherwise(F.array_append(s["node"], step)).alias("node"),
            F.when(second, F.array_append(s["weight"], s["held"] + w)).otherwise(s["weight"]).alias("weight"),
            F.when(second, F.lit(0).cast("bigint")).otherwise(w).alias("held"),
        )

    picks = F.when(m > 1, F.sequence(F.lit(0), 2 * m - 3)).otherwise(none)
    return F.aggregate(picks, start, take)


def code_lengths(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """``histogram`` (keys, bin, n) with ``length``: that of an optimal prefix code; 0 where a group has one bin only."""
    groups = histogram.filter("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "bin"))).alias("leaves"))
    steps = groups.select(*keys, "leaves", _merged(F.col("leaves")).alias("s"))
    # a node's depth is its parent's and 1 more; parents are born later, so the fold goes from the last node (the root) back
    last = F.size("leaves") - 2
    depths = F.aggregate(
        F.sequence(F.lit(1), last), F.array(F.lit(0)), lambda d, r: F.array_append(d, F.get(d, last - F.get(F.col("s.node"), last - r)) + 1)
    )
    steps = steps.withColumn("depths", F.when(last > 0, depths).otherwise(F.array(F.lit(0))))
    length = F.when(last < 0, F.lit(0)).otherwise(F.get("depths", last - F.get(F.col("s.leaf"), F.col("i"))) + 1)
    return steps.select(*keys, "s", "depths", "leaves", F.posexplode("leaves").alias("i", "leaf")).select(*keys, F.col("leaf.bin").alias("bin"), F.col("leaf.n").alias("n"), length.cast("bigint").alias("length"))


def canonical_codes(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """``lengths`` with ``code``: codes count up from the longest ones, in order of bin, and drop low bits on the way to shorter ones; so a code is
    the sum of 2^-length of all before it, in units of its own length. Null where the group's longest code passes 32 bits or there is none."""
    group = W.partitionBy(*keys)
    longest = F.max("length").over(group)
    unit = left(F.lit(1).cast("bigint"), F.col("longest") - F.col("length"))
    before = group.orderBy(F.col("length").desc(), "bin").rowsBetween(W.unboundedPreceding, -1)
    x = lengths.withColumn("longest", longest).withColumn("unit", F.when(F.col("longest").between(1, LONGEST), unit))
    x = x.withColumn("low", F.coalesce(F.sum("unit").over(before), F.lit(0)))
    code = F.when(F.col("unit").isNotNull(), right(F.col("low"), F.col("longest") - F.col("length")))
    return x.select(*lengths.columns, code.alias("code"))


def code_totals(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: bins, values, longest code, coded bits, the entropy in bits (a lower bound) and the Kraft sum in units of 2^-32 (2^32: complete)."""
    total = F.sum("n").over(W.partitionBy(*keys))
    own = F.col("n") * F.log2(F.col("total") / F.col("n"))
    kraft = F.sum(F.when(F.col("length") <= LONGEST, left(F.lit(1).cast("bigint"), LONGEST - F.col("length"))))
    g = lengths.withColumn("total", total).groupBy(*keys)
    return g.agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_values"), F.max("length").alias("longest"), F.sum(F.col("n") * F.col("length")).alias("bits"), F.round(F.sum(own), 3).alias("entropy_bits"), kraft.alias("kraft"))


def _words(bits: Column) -> Column:
    return F.floor((bits + 31) / 32).cast("bigint") * 4


def coded_bytes(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: first bin and number of bins of the shortest circular stretch that holds all used ones (of equal ones that from first to last, else the one after the first gap), and the bytes of code table (four numbers, the stretch's
    lengths stuffed, the codes) and coded values (with a word to read ahead into). ``bytes`` is null where there is no code: one bin, or more than 32 bits."""
    w = W.partitionBy(*keys)
    nxt = F.coalesce(F.lead("bin").over(w.orderBy("bin")), F.min("bin").over(w) + 256)
    gaps = lengths.withColumn("next", nxt)
    g = gaps.groupBy(*keys).agg(
        F.count("*").alias("n_bins"), F.max(F.struct((F.col("next") - F.col("bin")).alias("gap"), (F.col("next") > 255).alias("outer"), (-F.col("next")).alias("next"))).alias("widest"),
        F.max("length").alias("longest"), F.sum("length").alias("code_bits"), F.sum(F.col("n") * F.col("length")).alias("bits"),
    )
    stretch = 257 - F.col("widest.gap")
    table = 16 + stuffed_bytes(stretch, F.col("longest")) + _words(F.col("code_bits"))
    some = (F.col("n_bins") > 1) & (F.col("longest") <= LONGEST)
    return g.select(*keys, F.pmod(-F.col("widest.next"), F.lit(256)).alias("begin"), stretch.alias("stretch"), "longest", F.when(some, table).alias("table_bytes"), F.when(some, table + _words(F.col("bits")) + 4).alias("bytes"))


def value_or_delta(values: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Which of two codings is smaller, from their histograms: bytes of both and the choice ('value' where they are the same; null where neither has a code)."""
    one = lambda h, name: coded_bytes(code_lengths(h, keys), keys).select(*keys, F.col("bytes").alias(name))
    both = one(values, "value_bytes").join(one(deltas, "delta_bytes"), keys)
    choice = F.when(F.col("value_bytes").isNotNull() & (F.col("delta_bytes").isNull() | (F.col("value_bytes") <= F.col("delta_bytes"))), "value").when(F.col("delta_bytes").isNotNull(), "delta")
    return both.withColumn("choice", choice).withColumn("bytes", F.least("value_bytes", "delta_bytes"))


