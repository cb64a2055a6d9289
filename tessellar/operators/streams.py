"""Byte streams of the format as relations: stuffed bits, run coders and checksums, computed where Spark keeps the values.

A stream may be a whole plane or mask, so none of its steps orders it in one task: positions are cut into chunks, a window works within a
chunk, and what a chunk needs of the others (the next start, the last end) comes from a table of one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .prefix import left, right
from .transforms import bit_width

#: Positions of a chunk.
CHUNK = 1 << 16
_WORD = (1 << 32) - 1


# ---------------------------------------------------------------- stuffed bits


def stuffed_words(quanta: DataFrame, keys: list[str], old: bool = False) -> DataFrame:
    """keys, n, bits, word, value: the 32-bit words in which the quanta (keys, ``i`` from 0, ``q``) are stuffed at the width of the largest of their keys.

    Bit i * bits is where value i begins, counted from the low end of each word, or (``old``) from its high end. A value that straddles two words is split into
    two contributions, which share no bits, so words are bitwise sums. In the old order the last word is shifted down to the bytes it needs."""
    group = W.partitionBy(*keys)
    x = quanta.withColumn("bits", F.max(bit_width(F.col("q"))).over(group)).withColumn("n", F.count("*").over(group)).filter("bits > 0")
    at = F.col("i") * F.col("bits")
    x = x.withColumn("word", F.shiftright(at, 5)).withColumn("s", at.bitwiseAND(F.lit(31)))
    q, s, bits = F.col("q"), F.col("s"), F.col("bits")
    over = s + bits - 32  # bits that go into the next word
    if old:
        first = F.when(over > 0, right(q, over)).otherwise(left(q, -over))
        second = left(q, 32 - over).bitwiseAND(F.lit(_WORD))
    else:
        first, second = left(q, s).bitwiseAND(F.lit(_WORD)), right(q, 32 - s)
    parts = F.array(F.struct(F.col("word").alias("word"), first.alias("value")), F.struct((F.col("word") + 1).alias("word"), F.when(over > 0, second).alias("value")))
    words = x.select(*keys, "n", "bits", F.inline(parts)).filter("value is not null").groupBy(*keys, "n", "bits", "word").agg(F.bit_or("value").alias("value"))
    if old:
        need = F.floor((F.col("n") * F.col("bits") + 7) / 8)
        spare = F.when(F.col("word") == F.floor((need - 1) / 4), 8 * F.pmod(-need, F.lit(4))).otherwise(0)
        words = words.withColumn("value", right(F.col("value"), spare))
    return words


def unstuffed(words: DataFrame, keys: list[str], old: bool = False) -> DataFrame:
    """keys, i, q: the inverse. A group's words are one small array; each value is two shifts of the words it touches."""
    n, bits = F.col("n"), F.col("bits")
    sorted_ = F.array_sort(F.collect_list(F.struct("word", "value")))
    g = words.groupBy(*keys, "n", "bits").agg(F.transform(sorted_, lambda w: w["value"]).alias("w"))
    if old:
        spare = 8 * F.pmod(-F.floor((n * bits + 7) / 8), F.lit(4))
        g = g.withColumn("w", F.transform("w", lambda v, k: F.when(k == F.size("w") - 1, left(v, spare)).otherwise(v)))
    x = g.select(*keys, "bits", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i"))
    at = F.col("i") * bits
    k, s = F.shiftright(at, 5).cast("int"), at.bitwiseAND(F.lit(31))
    a, b, over = F.get("w", k), F.coalesce(F.get("w", k + 1), F.lit(0)), s + bits - 32
    mask = left(F.lit(1).cast("bigint"), bits) - 1
    if old:
        q = F.when(over > 0, left(a, over).bitwiseOR(right(b, 32 - over))).otherwise(right(a, -over))
    else:
        q = right(a, s).bitwiseOR(F.when(over > 0, left(b, 32 - s)).otherwise(0))
    return x.select(*keys, "i", q.bitwiseAND(mask).alias("q"))


# ---------------------------------------------------------------- runs


def _next_start(starts: DataFrame, keys: list[str], end: DataFrame) -> DataFrame:
    """``starts`` (keys, chunk, start, ...) with ``stop``: the next start of the stream, or its end. Within a chunk by a window, across chunks by the chunks' first starts."""
    own = F.lead("start").over(W.partitionBy(*keys, "chunk").orderBy("start"))
    first = starts.groupBy(*keys, "chunk").agg(F.min("start").alias("first"))
    later = first.select(*keys, "chunk", F.lead("first").over(W.partitionBy(*keys).orderBy("chunk")).alias("later"))
    return starts.withColumn("own", own).join(later, [*keys, "chunk"]).join(end, keys).withColumn("stop", F.coalesce("own", "later", "size")).drop("own", "later")


def _last_end(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``runs`` (keys, chunk, start, taken) with ``since``: where the one before it in the stream ends, 0 for the first."""
    own = F.lag("taken").over(W.partitionBy(*keys, "chunk").orderBy("start"))
    last = runs.groupBy(*keys, "chunk").agg(F.max("taken").alias("last"))
    before = last.select(*keys, "chunk", F.lag("last").over(W.partitionBy(*keys).orderBy("chunk")).alias("earlier"))
    return runs.withColumn("own", own).join(before, [*keys, "chunk"]).withColumn("since", F.coalesce("own", "earlier", F.lit(0))).drop("own", "earlier")


def _pieces(length: Column, most: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.floor((length - 1) / most))


def run_segments(stream: DataFrame, keys: list[str], least: int, most: int, most_literal: int, repeat_bytes: int, literal_head: int) -> DataFrame:
    """keys, start, length, byte, bytes: the segments in which a run coder writes each stream (keys, ``pos`` from 0 without gaps, ``byte``): runs of at least ``least`` equal bytes
    as repeats of up to ``most`` (``byte`` is theirs), all else, short rests of repeats too, as literals of up to ``most_literal`` (``byte`` null); ``bytes``: what a segment takes.

    First pass: run starts are where a byte differs from the one before (a chunk's first one from the last of the chunk before, which is dealt into it as well). Second pass, over
    repeats only: the literal stretch before each is what lies between it and the end of the last repeat."""
    size = stream.groupBy(*keys).agg((F.max("pos") + 1).alias("size"))
    chunk = F.floor(F.col("pos") / CHUNK).cast("bigint")
    last = F.col("pos") % CHUNK == CHUNK - 1
    dealt = stream.select(*keys, "pos", "byte", F.explode(F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("chunk"))
    before = F.lag("byte").over(W.partitionBy(*keys, "chunk").orderBy("pos"))
    starts = dealt.withColumn("before", before).filter((F.col("chunk") == chunk) & (F.col("before").isNull() | (F.col("before") != F.col("byte")))).select(*keys, "chunk", F.col("pos").alias("start"), "byte")
    runs = _next_start(starts, keys, size).withColumn("n", F.col("stop") - F.col("start")).filter(F.col("n") >= least)
    rest = F.col("n") % most
    runs = runs.withColumn("taken", F.col("stop") - F.when(rest < least, rest).otherwise(0))
    repeats = _last_end(runs.select(*keys, "chunk", "start", "byte", "taken"), keys)
    piece = lambda start, end, cap: F.transform(_pieces(end - start, cap), lambda k: F.struct((start + k * cap).alias("start"), F.least(F.lit(cap), end - start - k * cap).alias("length")))
    as_repeats = repeats.select(*keys, F.inline(piece(F.col("start"), F.col("taken"), most)), "byte").withColumn("bytes", F.lit(repeat_bytes).cast("bigint"))
    # the stretch after the last repeat of a stream, all of it where there is none
    ends = size.join(repeats.groupBy(*keys).agg(F.max("taken").alias("since")), keys, "left").select(*keys, F.coalesce("since", F.lit(0)).alias("since"), F.col("size").alias("until"))
    between = repeats.select(*keys, "since", F.col("start").alias("until")).unionByName(ends).filter("until > since")
    literals = between.select(*keys, F.inline(piece(F.col("since"), F.col("until"), most_literal)))
    literals = literals.select(*keys, "start", "length", F.lit(None).cast("bigint").alias("byte"), (F.col("length") + literal_head).alias("bytes"))
    return as_repeats.select(*keys, "start", "length", "byte", "bytes").unionByName(literals)


def rle_segments(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Mask bytes in runs with signed 16-bit counts: repeats from 5, up to 32,767. (A stream also ends with two bytes.)"""
    return run_segments(stream, keys, 5, 32767, 32767, 3, 2)


def packbits_segments(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Plane bytes in packed runs: repeats from 2, up to 129, literals up to 128, each with a byte for its count."""
    return run_segments(stream, keys, 2, 129, 128, 2, 1)


def coded_size(segments: DataFrame, keys: list[str], end: int = 0) -> DataFrame:
    """keys, n_repeats, n_literals, bytes: segments of each kind and the bytes of the coded stream, its end mark of ``end`` bytes included."""
    g = segments.groupBy(*keys)
    return g.agg(F.count("byte").alias("n_repeats"), F.count_if(F.col("byte").isNull()).alias("n_literals"), (F.sum("bytes") + end).alias("bytes"))


# ---------------------------------------------------------------- checksum


def fletcher32(blobs: DataFrame, keys: list[str], data: str = "data", skip: int = 0, chunk: int = 4096) -> DataFrame:
    """keys, checksum: Fletcher's sum over the big-endian 16-bit words of each binary value from byte ``skip`` on (an odd last byte is a high one).

    A value is cut into ranges of ``chunk`` bytes (even), which are summed wherever they are dealt to; of a range only its words' sum, their sum weighted by the words from each to the range's end, and
    their number are kept. Ranges combine in any order: a range's weighted sum grows by its plain sum times the words after it."""
    x = blobs.select(*keys, F.expr(f"substring({data}, {skip + 1})").alias("_data"))
    size = F.octet_length("_data")
    ranges = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / chunk).cast("int")))
    x = x.select(*keys, F.floor((size + 1) / 2).alias("_words"), "_data", F.explode(ranges).alias("_range"))
    x = x.select(*keys, "_words", "_range", F.expr(f"substring(_data, _range * {chunk} + 1, {chunk})").alias("_part"))
    count = F.floor((F.octet_length("_part") + 1) / 2).cast("int")
    word = lambda i: F.conv(F.rpad(F.hex(F.substring("_part", 2 * i + 1, F.lit(2))), 4, "0"), 16, 10).cast("bigint")
    x = x.withColumn("_own", F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), word)).otherwise(F.array().cast("array<bigint>")))
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    sums = F.aggregate("_own", zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["t"] + a["s"] + v).alias("t")))  # t: the sum of the running sums
    x = x.select(*keys, (F.col("_words") - F.col("_range") * (chunk // 2) - F.size("_own")).alias("_after"), sums.alias("_f"))
    plain, weighted = F.col("_f.s") % 65535, F.col("_f.t") % 65535
    g = x.groupBy(*keys).agg(F.sum(plain).alias("_s"), F.sum((weighted + plain * (F.col("_after") % 65535)) % 65535).alias("_t"))
    fold = lambda c: F.when(c % 65535 == 0, 65535).otherwise(c % 65535)  # noqa: E731  sums start at 65535, so 0 is written as 65535
    return g.select(*keys, (fold(F.col("_t")) * 65536 + fold(F.col("_s"))).cast("bigint").alias("checksum"))


def let(value: Column, body) -> Column:
    """``body`` of a column, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def checksum_of(data: Column) -> Column:
    """The same sum of one binary column's value, in the row: for values that a task holds anyway."""
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"))
    fold = lambda c: F.when(c == 0, 65535).otherwise(c)

    def summed(b: Column) -> Column:
        word = lambda i: F.conv(F.rpad(F.hex(F.substring(b, 2 * i + 1, F.lit(2))), 4, "0"), 16, 10).cast("bigint")
        add = lambda a, i: let((a["s"] + word(i)) % 65535, lambda s: F.struct(s.alias("s"), ((a["t"] + s) % 65535).alias("t")))
        count = F.floor((F.octet_length(b) + 1) / 2).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, zero, add, lambda a: fold(a["t"]) * 65536 + fold(a["s"])).cast("bigint")

    return let(data, summed)
