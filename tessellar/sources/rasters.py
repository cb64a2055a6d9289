"""Pixel relations: one row a value, keyed by (band, row, col, depth), with ``z`` and ``valid``.

Row order means nothing in Spark, so position is in the keys. Every raster here is a projection of one table: scans keep column
pruning and filters on the keys become filters on the table's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics

KEYS = ("band", "row", "col", "depth")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(df: DataFrame, key: str, width: int, z, valid=None, band=0) -> DataFrame:
    k = F.col(key)
    return df.select(
        F.lit(band).cast("bigint").alias("band") if isinstance(band, int) else band.alias("band"),
        F.floor(k / width).cast("bigint").alias("row"), (k % width).cast("bigint").alias("col"), F.lit(0).cast("bigint").alias("depth"),
        z.cast("double").alias("z"), (F.lit(True) if valid is None else valid).alias("valid"),
    )


def _in_tasks(e: DataFrame) -> DataFrame:
    """Vectors in tasks of about ``TASK_ROWS`` components: a split of the file, a row group at least, may hold so many that its task would keep gigabytes of pixels on their way into a shuffle.
    Left as they are where a task a core is enough."""
    n = -(-(e.agg(F.sum(F.size("embedding"))).first()[0] or 0) // statistics.TASK_ROWS)
    return e.repartition(n, "vec_id") if n > e.sparkSession.sparkContext.defaultParallelism else e


def embed(spark, sf_dir, depth: int = 1, spread: bool = False) -> DataFrame:
    """The embeddings as rows of a float raster; with ``depth`` n, n neighbouring components are the depths of a pixel. ``spread``: for shuffles of the pixels."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    e = (_in_tasks(e) if spread else e).select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("i", "z"))
    i = F.col("i")
    return e.select(
        F.lit(0).cast("bigint").alias("band"), F.col("row"), F.floor(i / depth).cast("bigint").alias("col"), (i % depth).cast("bigint").alias("depth"),
        F.col("z").cast("double").alias("z"), F.lit(True).alias("valid"),
    )


def events(spark, sf_dir) -> DataFrame:
    """100 events a row, two decimals; errors are invalid."""
    return _grid(_table(spark, sf_dir, "events"), "event_id", 100, F.col("value"), F.col("event_type") != "error")


def event_bands(spark, sf_dir) -> DataFrame:
    """Two bands of the events with different masks: errors in band 0, every seventh user in band 1."""
    e = _table(spark, sf_dir, "events")
    a = _grid(e, "event_id", 100, F.col("value"), F.col("event_type") != "error", 0)
    return a.unionByName(_grid(e, "event_id", 100, F.col("value") * 2, F.col("user_id") % 7 != 0, 1))


def dirty(spark, sf_dir, nodata: float = -9999.0) -> DataFrame:
    """Events as pixels of two depths, with NaN for some users and a no-data value for others; all marked valid."""
    e = _table(spark, sf_dir, "events")
    nan, nd, both = F.col("user_id") % 11 == 0, F.col("user_id") % 13 == 0, F.col("user_id") % 2 == 0
    zs = [F.when(nan & (both | F.lit(d == 0)), F.lit(float("nan"))).when(nd & (both | F.lit(d == 1)), F.lit(nodata)).otherwise(F.col("value") + d) for d in (0, 1)]
    out = [_grid(e, "event_id", 100, z).withColumn("depth", F.lit(d).cast("bigint")) for d, z in enumerate(zs)]
    return out[0].unionByName(out[1])


def orders(spark, sf_dir) -> DataFrame:
    return _grid(_table(spark, sf_dir, "orders"), "o_orderkey", 100, F.col("o_totalprice"))


def psize(spark, sf_dir, masked: bool = False) -> DataFrame:
    """Part sizes, 50 a row: 8-bit unsigned values."""
    return _grid(_table(spark, sf_dir, "part"), "p_partkey", 50, F.col("p_size"), F.col("p_partkey") % 7 != 0 if masked else None)


_HEAD = "CAST({b} AS BIGINT) AS band, CAST({k} // {w} AS BIGINT) AS \"row\", CAST({k} % {w} AS BIGINT) AS col, CAST({d} AS BIGINT) AS depth"


def _sql(b, k, w, z, valid, table, d=0):
    return f"SELECT {_HEAD.format(b=b, k=k, w=w, d=d)}, CAST({z} AS DOUBLE) AS z, ({valid}) AS valid FROM {table}"


def _embed_sql(depth):
    return f"SELECT CAST(0 AS BIGINT) AS band, vec_id AS \"row\", CAST(i // {depth} AS BIGINT) AS col, CAST(i % {depth} AS BIGINT) AS depth, CAST(embedding[i + 1] AS DOUBLE) AS z, TRUE AS valid FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)"


def _dirty_sql(d):
    nan, nd, both = "user_id % 11 = 0", "user_id % 13 = 0", "user_id % 2 = 0"
    return _sql(0, "event_id", 100, f"CASE WHEN {nan} AND ({both} OR {d} = 0) THEN CAST('nan' AS DOUBLE) WHEN {nd} AND ({both} OR {d} = 1) THEN -9999.0 ELSE value + {d} END", "TRUE", "events", d)


#: The same rasters as SQL, for the oracle.
SQL = {
    "embed": _embed_sql(1), "embed4": _embed_sql(4),
    "events": _sql(0, "event_id", 100, "value", "event_type <> 'error'", "events"),
    "event_bands": _sql(0, "event_id", 100, "value", "event_type <> 'error'", "events") + " UNION ALL " + _sql(1, "event_id", 100, "value * 2", "user_id % 7 <> 0", "events"),
    "dirty": _dirty_sql(0) + " UNION ALL " + _dirty_sql(1),
    "orders": _sql(0, "o_orderkey", 100, "o_totalprice", "TRUE", "orders"),
    "psize": _sql(0, "p_partkey", 50, "p_size", "TRUE", "part"), "psize_masked": _sql(0, "p_partkey", 50, "p_size", "p_partkey % 7 <> 0", "part"),
}


def byte_bands(spark, sf_dir) -> DataFrame:
    """8-bit bands of unlike kinds: part sizes with holes, embeddings, event values, order prices' low byte, and a smooth ramp over the orders."""
    b = lambda df, band, z: df.select(F.lit(band).cast("bigint").alias("band"), "row", "col", "depth", F.pmod(F.floor(z).cast("bigint"), F.lit(256)).cast("double").alias("z"), "valid")
    z = F.col("z")
    out = [b(psize(spark, sf_dir, True), 0, z), b(embed(spark, sf_dir, spread=True), 1, z * 64 + 128), b(events(spark, sf_dir), 2, z), b(orders(spark, sf_dir), 3, z), b(orders(spark, sf_dir), 4, F.col("row") / 8 + F.col("col") / 2)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def _byte(source: str, band: int, z: str) -> str:
    return f"SELECT CAST({band} AS BIGINT) AS band, \"row\", col, depth, CAST(((CAST(floor({z}) AS BIGINT) % 256) + 256) % 256 AS DOUBLE) AS z, valid FROM ({source})"


SQL["byte_bands"] = " UNION ALL ".join([_byte(SQL["psize_masked"], 0, "z"), _byte(SQL["embed"], 1, "z * 64 + 128"), _byte(SQL["events"], 2, "z"), _byte(SQL["orders"], 3, "z"), _byte(SQL["orders"], 4, '"row" / 8 + col / 2')])


def float_bands(spark, sf_dir) -> DataFrame:
    """32-bit float bands, all valid: embeddings, order prices and event values (some negative)."""
    single = lambda df, band, z: df.select(F.lit(band).cast("bigint").alias("band"), "row", "col", "depth", z.cast("float").cast("double").alias("z"), F.lit(True).alias("valid"))
    z = F.col("z")
    return single(embed(spark, sf_dir, spread=True), 0, z).unionByName(single(orders(spark, sf_dir), 1, z)).unionByName(single(events(spark, sf_dir), 2, z - 50))


def double_bands(spark, sf_dir) -> DataFrame:
    """64-bit bands: order prices and event values divided by 3."""
    z = F.col("z")
    two = [df.select(F.lit(b).cast("bigint").alias("band"), "row", "col", "depth", v.alias("z"), F.lit(True).alias("valid")) for b, (df, v) in enumerate(((orders(spark, sf_dir), z), (events(spark, sf_dir), z / 3)))]
    return two[0].unionByName(two[1])


_FLOAT = "SELECT CAST({b} AS BIGINT) AS band, \"row\", col, depth, CAST(CAST({z} AS FLOAT) AS DOUBLE) AS z, TRUE AS valid FROM ({s})"
SQL["float_bands"] = " UNION ALL ".join(_FLOAT.format(b=b, s=SQL[s], z=z) for b, (s, z) in enumerate((("embed", "z"), ("orders", "z"), ("events", "z - 50"))))
SQL["double_bands"] = " UNION ALL ".join(f'SELECT CAST({b} AS BIGINT) AS band, "row", col, depth, CAST({z} AS DOUBLE) AS z, TRUE AS valid FROM ({SQL[s]})' for b, (s, z) in enumerate((("orders", "z"), ("events", "z / 3"))))


def flat_bands(spark, sf_dir) -> DataFrame:
    """``byte_bands`` and two more: one of a single value, one without valid pixels."""
    p = psize(spark, sf_dir)
    more = [p.withColumn("band", F.lit(5).cast("bigint")).withColumn("z", F.lit(9.0)), p.withColumn("band", F.lit(6).cast("bigint")).withColumn("valid", F.lit(False))]
    sparse = p.withColumn("band", F.lit(7).cast("bigint")).withColumn("z", (F.col("z") > 48).cast("double"))
    return byte_bands(spark, sf_dir).unionByName(more[0]).unionByName(more[1]).unionByName(sparse)


_P = SQL["psize"]
SQL["flat_bands"] = SQL["byte_bands"] + "".join(f' UNION ALL SELECT CAST({b} AS BIGINT), "row", col, depth, {z}, {v} FROM ({_P})' for b, z, v in ((5, "CAST(9 AS DOUBLE)", "TRUE"), (6, "z", "FALSE"), (7, "CAST(z > 48 AS DOUBLE)", "TRUE")))


def int_depths(spark, sf_dir) -> DataFrame:
    """Orders as pixels of four 32-bit integer depths: the price, the price and the row (differences are smaller), the customer, and a pattern of the whole range (some differences pass 32 bits)."""
    o, k, v = _table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    row = F.floor(k / 100)
    zs = [v, v + row, F.col("o_custkey").cast("double"), F.when(row % 3 == 0, F.lit(-2147483648.0)).otherwise((k * 7919 % 100003 * 20000).cast("double"))]
    return o.select(
        F.lit(0).cast("bigint").alias("band"), row.cast("bigint").alias("row"), (k % 100).cast("bigint").alias("col"),
        F.posexplode(F.array(*zs)).alias("depth", "z"), (F.col("o_orderstatus") != "P").alias("valid"),
    ).withColumn("depth", F.col("depth").cast("bigint"))


SQL["int_depths"] = """SELECT CAST(0 AS BIGINT) AS band, CAST(o_orderkey // 100 AS BIGINT) AS "row", CAST(o_orderkey % 100 AS BIGINT) AS col, CAST(k AS BIGINT) AS depth, CAST(CASE k WHEN 0 THEN floor(o_totalprice)
    WHEN 1 THEN floor(o_totalprice) + o_orderkey // 100 WHEN 2 THEN o_custkey ELSE CASE WHEN (o_orderkey // 100) % 3 = 0 THEN -2147483648 ELSE o_orderkey * 7919 % 100003 * 20000 END END AS DOUBLE) AS z, o_orderstatus <> 'P' AS valid FROM orders, range(4) t(k)"""
