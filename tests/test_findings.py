"""What reviews found: each test failed before its mending."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import plain

from tessellar.functions import blob as codec
from tessellar.operators import costs, statistics
from tessellar.plans import registry
from tessellar.sources import blobs as source
from tessellar.sources import rasters

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["nan_to_mask_v5", "nodata_to_mask"])
def test_null_values_as_in_sql(spark, tmp_path, name):
    """Null values stand in some depths beside NaN and no-data, or in all of them."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when event_id % 3 = 0 then null else value end as value) from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def raster(spark, rows=400, cols=100):
    """8-bit values that compress well, some invalid."""
    i = F.col("id")
    return spark.range(rows * cols).select(
        F.lit(0).cast("bigint").alias("band"), F.floor(i / cols).cast("bigint").alias("row"), (i % cols).alias("col"), F.lit(0).cast("bigint").alias("depth"),
        F.floor(i / cols % 256).cast("double").alias("z"), (i % 11 != 0).alias("valid"),
    )


def most_rows(df):
    """Of the tasks that ``df`` comes from."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_tasks_of_blocks_are_bounded(spark, monkeypatch):
    """Tiles of both sizes in tasks of a set number of rows, at two sizes, and the same bytes as in one task."""
    seen = []
    monkeypatch.setattr(costs, "tile_costs", lambda x, *a, f=costs.tile_costs, **k: seen.append(x) or f(x, *a, **k))
    for rows in (400, 1600):
        px = raster(spark, rows)
        monkeypatch.setattr(statistics, "TASK_ROWS", 10**9, raising=False)
        want = costs.block_size_choice(px, 0.5, "uchar").collect()
        monkeypatch.setattr(statistics, "TASK_ROWS", 4000)
        seen.clear()
        assert costs.block_size_choice(px, 0.5, "uchar").collect() == want
        assert [most_rows(x) < 3 * 4000 for x in seen] == [True, True]


def test_tasks_of_stripes_are_bounded(spark, monkeypatch):
    """Differences by stripes in tasks of a set number of rows, without a second shuffle of the pixels, and the same counts as in one task."""
    for rows in (640, 2560):
        px = raster(spark, rows)
        monkeypatch.setattr(statistics, "TASK_ROWS", 10**9, raising=False)
        want = sorted(statistics.delta_histogram(px).collect())
        monkeypatch.setattr(statistics, "TASK_ROWS", 8000)
        assert sorted(statistics.delta_histogram(px).collect()) == want
        assert most_rows(statistics.striped(px)) < 6 * 8000
        assert most_rows(statistics.predicted_delta(px)) < 6 * 8000


def test_stripes_before_need_no_sorted_pixels(spark):
    """The last value of the stripes before comes from an aggregate that holds a row for each stripe, not a split's pixels, and is right after stripes without valid pixels and in wide rows."""
    for px in (raster(spark, 640, 10), raster(spark, 300, 700)):
        stripe, r, c = F.floor(F.col("row") / statistics.STRIPE), F.col("row"), F.col("col")
        px = px.withColumn("valid", (stripe != 1) & (r % 64 != 63) & (r % 64 != 0) & ((r * 7 + c) % 5 != 0)).withColumn("z", (r * 31 + c * 17 + c * r % 13) % 256.0)
        got = statistics.predicted_delta(px)
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
        known, last, want = {}, 0.0, []
        for row, col, z, ok in px.select("row", "col", "z", "valid").orderBy("row", "col").collect():
            if ok:
                want.append((row, col, z - known.get((row, col - 1), known.get((row - 1, col), last))))
                known[row, col] = last = z
        assert sorted(map(tuple, got.select("row", "col", "delta").collect())) == want


@pytest.mark.parametrize("bands, band", [("byte_bands", 1), ("float_bands", 0)])
def test_vectors_of_a_split_share_out_their_pixels(spark, monkeypatch, bands, band):
    """A file of one row group is read by one task, whose vectors become pixels in tasks of a set number of rows; the same pixels as in one task."""
    want = plain(getattr(rasters, bands)(spark, SF).collect())
    n = sum(1 for r in want if r[0] == band)
    monkeypatch.setattr(statistics, "TASK_ROWS", n // 12)
    got = getattr(rasters, bands)(spark, SF)
    assert most_rows(got.filter(F.col("band") == band)) < 3 * n // 12
    assert plain(got.collect()) == want


def test_files_share_tasks(tmp_path):
    """Many small blob files are few tasks, each file in one of them; a damaged or skipped file ends nothing but itself; large files have tasks of their own."""
    z = np.arange(64.0).reshape(1, 8, 8, 1)
    for k in range(600):
        data = bytes(codec.encode(z + (100 if k % 3 == 0 else -1000), np.ones((1, 8, 8), bool)))
        (tmp_path / f"{k:04}.blob").write_bytes(b"none" if k % 50 == 1 else data)
    reader = source._Reader({"path": str(tmp_path), "low": "0"})
    tasks = reader.partitions()
    assert 1 < len(tasks) <= 3
    assert sorted(f for t in tasks for f in t.value) == sorted(str(f) for f in tmp_path.glob("*.blob"))
    got = [r[0] for t in tasks for r in reader.read(t)]
    assert got == [str(tmp_path / f"{k:04}.blob") for k in range(600) if k % 3 == 0 and k % 50 != 1]
    for k in range(2):
        with open(tmp_path / f"large{k}.blob", "wb") as f:
            f.truncate(source.TASK_BYTES)
    assert [len(t.value) for t in reader.partitions()][-2:] == [1, 1]
    assert [t.value for t in source._Reader({"path": str(tmp_path / "none")}).partitions()] == [[]]
