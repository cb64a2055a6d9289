"""What the operators of this subpackage share: tables in the shared folder, session settings, word splitting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds at most; the mean document is a few KB, so that a batch is a few MB.
ARROW_ROWS = 500
#: Bytes an Arrow batch holds about at most, for tables with very long texts.
ARROW_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive (by rows and by bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset (tests), a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later jobs neither recompute it nor
    depend on the executors that made it. ``few``: a sixteenth of the session's partitions write it, for tables of ids and
    numbers between the rounds of an iteration, whose files would otherwise be tiny."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(4, n_parts(spark) // 16))
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_folder", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner does so when the driver's garbage is collected, which else may
    be only every half hour (``spark.cleaner.periodicGC.interval``)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_array(positions: DataFrame, size: int) -> bytes:
    """A bit array of ``size`` (a power of two, 2**14 to 2**27) in bytes, lowest bit first, with the bits set that the one bigint column of
    ``positions`` names. Executors build it in pieces of up to 64 KB; the driver gets at most 16 MB."""
    import numpy as np
    import pyarrow as pa

    piece = min(size >> 3, 1 << 16)
    at = positions.select(F.col(positions.columns[0]).alias("b"))
    eights = at.groupBy(F.shiftright("b", 3).alias("w")).agg(F.expr("bit_or(shiftleft(1, cast(b % 8 as int)))").alias("v"))

    def run(batches):
        found: dict = {}
        for batch in batches:
            w, v = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in np.unique(w // piece).tolist():
                of = w // piece == k
                found.setdefault(k, np.zeros(piece, np.uint8))[w[of] % piece] |= v[of].astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["k", "bits"])

    parts = max(1, min(n_parts(positions.sparkSession), (size >> 3) // piece))
    rows = eights.repartition(parts, F.expr(f"w div {piece}")).mapInArrow(run, "k bigint, bits binary").collect()
    out = bytearray(size >> 3)
    for k, bits in rows:
        out[k * piece : (k + 1) * piece] = bits
    return bytes(out)
