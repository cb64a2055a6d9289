"""Files of concatenated blobs, read in splits from any store that Spark reads.

A file is cut where the format's key stands: Spark's text source does that at the ends of its splits too (a split begins with the first key in it, and the
split before reads on to there), keeps bytes as they are, and goes through Spark's own file system. A piece is a blob's bytes without the key. Its header says
how long the blob is and what its checksum has to be, so that

* bytes behind a blob's end are skipped (writers may pad),
* a piece that is too short is joined with the pieces behind it, for a payload may hold the key by chance,
* a damaged blob loses itself alone, and one that the file's end cuts off is reported as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blob import KEY, NEWEST
from ..operators.planes import value_of
from ..operators.streams import checksum_of, let

#: Bytes of the longest header behind the key, and of a bucket in which pieces look for what they are a part of.
HEAD, BUCKET = 84, 1 << 20
#: A header that claims more bytes is taken for damaged (the format's sizes are signed 32-bit numbers).
LARGEST = 1 << 30
_PIECE = ["file", "split", "place"]


def write(blobs: DataFrame, path: str, column: str = "blob") -> None:
    """The blobs of ``blobs`` one behind the other in files of the folder ``path`` (a line feed between them), by Spark's own writer and committer."""
    blobs.select(F.col(column).cast("string").alias("value")).write.text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, split, place (in order within a split), piece: what stands before the first key of a file, then what follows each key, without the key."""
    t = spark.read.option("lineSep", KEY.decode()).text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("piece"))


def _unsigned(b: Column, at: Column, n: int) -> Column:
    """``n`` bytes (up to 7) from position ``at`` (from 0), lowest first."""
    return let(F.hex(F.substring(b, at + 1, F.lit(n))), lambda d: F.conv(F.concat(*[F.substring(d, 2 * k + 1, 2) for k in range(n - 1, -1, -1)]), 16, 10).cast("bigint"))


def _int(b: Column, at: Column) -> Column:
    return let(_unsigned(b, at, 4), lambda u: F.when(u < 1 << 31, u).otherwise(u - (1 << 32)))


def _double(b: Column, at: Column) -> Column:
    """Eight bytes as their sign and exponent, and the mantissa."""
    fields = F.struct(_unsigned(b, at, 6).alias("low"), _unsigned(b, at + 6, 2).alias("top"))
    return let(fields, lambda f: let(F.struct(F.floor(f["top"] / 16).alias("hi"), ((f["top"] % 16) * (1 << 48) + f["low"]).alias("lo")), lambda g: value_of(g["hi"], g["lo"], "double")))


def _header(b: Column) -> Column:
    """The header behind the key in ``b`` as a struct, with ``size`` including the key; null where there is none."""

    def fields(x: Column) -> Column:
        """``x``: the bytes, the version and where rows, valid count and error bound stand."""
        b, v = x["b"], x["v"]
        at = lambda name, k, read=_int: read(b, x[name] + k)
        found = F.struct(
            v.alias("version"), F.when(v >= 3, _unsigned(b, F.lit(4), 4)).alias("stored"), at("r", 0).alias("n_rows"), at("r", 4).alias("n_cols"), F.when(v >= 4, at("r", 8)).otherwise(1).alias("n_depth"),
            at("n", 0).alias("n_valid"), at("n", 8).alias("size"), at("n", 12).alias("dtype"), at("e", 0, _double).alias("max_error"), at("e", 8, _double).alias("z_min"), at("e", 16, _double).alias("z_max"), x["e"].alias("e"),
        )
        good = lambda h: (h["n_rows"] > 0) & (h["n_cols"] > 0) & (h["n_depth"] > 0) & h["n_valid"].between(0, h["n_rows"] * h["n_cols"]) & h["dtype"].between(0, 7) & h["size"].between(h["e"] + 30, LARGEST)
        return let(found, lambda h: F.when(good(h), h))

    def placed(v: Column) -> Column:
        r = F.when(v >= 3, 8).otherwise(4)
        n = r + F.when(v >= 4, 12).otherwise(8)
        return let(F.struct(b.alias("b"), v.alias("v"), r.alias("r"), n.alias("n"), (n + F.when(v >= 6, 24).otherwise(16)).alias("e")), fields)

    return F.when(F.octet_length(b) >= HEAD, let(_int(b, F.lit(0)), lambda v: F.when(v.between(2, NEWEST), placed(v))))


def _holds(h: Column, b: Column) -> Column:
    """Whether the blob of the header ``h`` and the bytes ``b`` behind its key is all there and has the checksum it names (version 2 has none)."""
    there = h.isNotNull() & (F.octet_length(b) >= h["size"] - len(KEY))
    return F.coalesce(F.when(there, h["stored"].isNull() | (checksum_of(F.substring(b, F.lit(9), (h["size"] - 14).cast("int"))) == h["stored"])), F.lit(False))


_HEADER = ["version", "n_rows", "n_cols", "n_depth", "n_valid", "size", "dtype", "max_error", "z_min", "z_max"]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, status and the header's fields of every blob in the files of ``path``, in whatever splits they are read.

    ``status``: ok, damaged (checksum or header), or truncated (the file ends first). Bytes before the first key of a file are no blob, nor is a key that ends it. Pieces' bytes stay in the tasks that read them; what is shuffled are
    rows of some numbers, and the bytes of pieces that are too short. Sums within splits, then over the splits of a file, give the offsets."""
    p = pieces(spark, path)
    key = len(KEY)
    light = p.select(*_PIECE, F.octet_length("piece").alias("length"), let(_header(F.col("piece")), lambda h: F.struct(h.alias("h"), _holds(h, F.col("piece")).alias("ok"))).alias("x"))
    light = light.select(*_PIECE, "length", F.col("x.ok").alias("ok"), *[F.col(f"x.h.{c}").alias(c) for c in _HEADER])
    sums = p.groupBy("file", "split").agg(F.sum(F.octet_length("piece") + key).alias("total"), F.min("place").alias("first"))
    files = W.partitionBy("file")
    before = F.coalesce(F.sum("total").over(files.orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("file", "split", before.alias("before"), (F.sum("total").over(files) - key).alias("end"), F.when(F.col("split") == F.min("split").over(files), F.col("first")).alias("head"))
    within = W.partitionBy("file", "split").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    x = light.withColumn("run", F.coalesce(F.sum(F.col("length") + key).over(within), F.lit(0))).join(sums, ["file", "split"])
    x = x.filter(F.col("head").isNull() | (F.col("place") != F.col("head"))).withColumn("offset", F.col("before") + F.col("run") - key)
    short = F.col("size").isNotNull() & (F.col("length") + key < F.col("size"))
    cut = short & (F.col("offset") + F.col("size") > F.col("end"))
    x = x.withColumn("status", F.when(F.col("ok"), "ok").when(cut, "truncated").when(short, "short").otherwise("damaged"))
    x = x.select("file", "split", "place", "offset", "length", "status", *_HEADER)
    if x.filter("status = 'short'").isEmpty():
        return x.select("file", "offset", "status", *_HEADER)
    return _joined(p, x)


def _joined(p: DataFrame, x: DataFrame) -> DataFrame:
    """The rows of ``x`` where pieces that are too short have been tried together with those behind them (found by file and bucket of the offset); what lies inside a blob found
    so goes."""
    key = len(KEY)
    first, last = F.floor(F.col("offset") / BUCKET), F.floor((F.col("offset") + F.col("size") - 1) / BUCKET)
    shorts = x.filter("status = 'short'").select("file", F.col("offset").alias("begin"), F.col("size").alias("whole"), F.explode(F.sequence(first, last)).alias("bucket"))
    at = x.select(*_PIECE, "offset", F.floor(F.col("offset") / BUCKET).alias("bucket"))
    inside = at.join(shorts, ["file", "bucket"]).filter("offset >= begin and offset < begin + whole").select(*_PIECE, "offset", "begin")
    parts = p.join(inside, _PIECE).groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    # the key stood between them
    together = F.aggregate(F.col("parts"), F.lit(b""), lambda a, s: F.when(F.octet_length(a) == 0, s["piece"]).otherwise(F.concat(a, F.lit(KEY), s["piece"])))
    tried = let(together, lambda b: let(_header(b), lambda h: F.when(_holds(h, b), h["size"])))
    found = parts.select("file", "begin", tried.alias("whole")).filter("whole is not null")
    covers = found.select("file", "begin", "whole", F.explode(F.sequence(F.floor(F.col("begin") / BUCKET), F.floor((F.col("begin") + F.col("whole") - 1) / BUCKET))).alias("bucket"))
    y = x.withColumn("bucket", F.floor(F.col("offset") / BUCKET)).alias("y")
    c = covers.alias("c")
    same = (F.col("y.file") == F.col("c.file")) & (F.col("y.bucket") == F.col("c.bucket"))
    y = y.join(c, same & (F.col("y.offset") > F.col("c.begin")) & (F.col("y.offset") < F.col("c.begin") + F.col("c.whole")), "left_anti")
    whole = found.select("file", F.col("begin").alias("offset"), F.lit(True).alias("mended"))
    y = y.join(whole, ["file", "offset"], "left")
    status = F.when(F.col("mended"), "ok").when(F.col("status") == "short", "damaged").otherwise(F.col("status"))
    return y.select("file", "offset", status.alias("status"), *_HEADER)
