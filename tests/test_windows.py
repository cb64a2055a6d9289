"""Windows read through the block index equal the full decode, filtered, for every way a band is stored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import blob as codec
from tessellar.operators import blobs, windows


def cases():
    r = np.random.default_rng(4)
    i, j = np.mgrid[0:70, 0:50]
    smooth = np.hypot(i, j)[None, :, :, None]
    full, holes = np.ones((1, 70, 50), bool), r.random((1, 70, 50)) < 0.7
    deep = np.concatenate([smooth + k * 3 for k in range(3)], axis=3)
    two = np.concatenate([smooth, smooth[:, ::-1]])
    yield "lossy", smooth.astype("<f4"), full, {"error": 0.01}
    yield "coarse", smooth, holes, {"error": 1.0}
    yield "integers with differences", np.floor(deep * 100).astype("<i4"), holes, {}
    yield "old", smooth.astype("<f4"), holes, {"error": 0.01, "version": 2}
    yield "bytes by codes", np.minimum(smooth, 40).astype("u1"), full, {}
    yield "planes", r.normal(size=(1, 70, 50, 1)).astype("<f4"), full, {}
    yield "constant", np.full((1, 70, 50, 1), 7.0), holes, {}
    yield "empty", smooth, np.zeros((1, 70, 50), bool), {}
    yield "bands that share a mask", two, np.repeat(holes, 2, axis=0), {"error": 0.05}
    mixed = deep.copy()
    mixed[0, ::7, ::5, 1] = -9999.0
    yield "no-data in single depths", mixed, full, {"error": 0.01, "nodata": [-9999.0]}


@pytest.mark.parametrize("name", [c[0] for c in cases()])
def test_window_equals_full_decode(spark, name):
    z, mask, options = next(c[1:] for c in cases() if c[0] == name)
    data = codec.encode(z, mask, options.get("error", 0.0), options.get("version", codec.NEWEST), options.get("nodata"))
    df = spark.createDataFrame([(0, 100, 200, bytearray(data)), (1, 170, 200, bytearray(data))], "tile bigint, row0 bigint, col0 bigint, blob binary")
    rows, cols = (113, 183), (217, 233)
    found = windows.index(df)
    got = windows.read_window(df, found, rows, cols)
    want = blobs.decode(df).filter(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))
    plain = lambda x: sorted((tuple(r) for r in x.select("tile", "band", "row", "col", "depth", "z", "valid").collect()), key=repr)
    assert plain(got) == plain(want)
    if not found.filter("whole").count():
        assert found.agg(F.sum("length")).first()[0] < 2 * len(data)
        read = found.filter(windows.touches(rows, cols)).agg(F.sum("length")).first()[0]
        assert 0 < read < len(data)
