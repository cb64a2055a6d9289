"""Concatenated blobs in splits: the same rows however a file is cut, and damage stays where it is."""

import os
import random

import numpy as np
import pytest

from tessellar.functions import blob as codec
from tessellar.sources import scan


def made(n=40, seed=3):
    """Blobs of several types and versions; every fifth holds the key in its payload."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        if k % 5 == 4:
            z = np.frombuffer((bytes(r.integers(0, 256, 50, dtype=np.uint8)) + codec.KEY + bytes(r.integers(0, 256, 30, dtype=np.uint8)) + codec.KEY * (k % 3)).ljust(400, b"\7"), np.uint8).reshape(20, 20)
            z = np.concatenate([z, r.integers(0, 256, (40, 20), dtype=np.uint8)])
            out.append(codec.encode(z[None, :, :, None], np.ones((1, *z.shape), bool)))
        else:
            z = r.normal(k, 5, (1, int(r.integers(5, 40)), int(r.integers(5, 40)), 1)).astype("<f4")
            out.append(codec.encode(z, r.random(z.shape[:3]) < 0.9, 0.01, version=(2, 3, 4, 5, 6)[k % 5]))
    return [bytes(x) for x in out]


def rows(spark, folder, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        return sorted((x.offset, x.status, x.version, x.n_rows, x.n_cols, x.n_valid, x.size, x.dtype, x.max_error, x.z_min, x.z_max) for x in scan.scan(spark, folder).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def put(tmp_path, data):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "x.blob").write_bytes(data)
    return f"file://{tmp_path}/in"


def want(blobs, pad):
    out, at = [], pad
    for b in blobs:
        h = codec.read_header(codec.Cursor(b))
        out.append((at, "ok", h.version, h.n_rows, h.n_cols, h.n_valid, h.size, h.kind, h.error, h.z_min, h.z_max))
        at += len(b) + pad
    return out


def test_payloads_hold_the_key():
    assert any(b.count(codec.KEY) > 1 for b in made())


@pytest.mark.parametrize("pad", [0, 3])
def test_same_rows_in_one_split_and_in_many(spark, tmp_path, pad):
    blobs = made()
    folder = put(tmp_path, b"".join(b"\1" * pad + b for b in blobs))
    one = rows(spark, folder, "1g")
    assert one == want(blobs, pad)
    size = sum(map(len, blobs))
    for n in (7, 50, 400):
        assert rows(spark, folder, str(size // n)) == one


def test_damage_stays_where_it_is(spark, tmp_path):
    blobs = made()
    expected = want(blobs, 0)
    hurt = [bytearray(b) for b in blobs]
    hurt[6][len(hurt[6]) // 2] ^= 1  # payload
    hurt[11][26] ^= 0x40  # a size or count in the header
    hurt[4][60] ^= 1  # a blob with a key inside
    hurt[20][4] = 0  # no key any more: joins the one before as bytes behind its end
    folder = put(tmp_path, b"".join(map(bytes, hurt)) + blobs[0][: len(blobs[0]) // 2])
    for size in ("1g", "1500"):
        got = rows(spark, folder, size)
        good = [x for x in got if x[1] == "ok"]
        assert good == [x for k, x in enumerate(expected) if k not in (6, 11, 4, 20)]
        assert [x[1] for x in got if x[0] >= sum(map(len, blobs))] == ["truncated"]
        assert {x[1] for x in got} == {"ok", "damaged", "truncated"}


def test_random_bytes_and_nothing(spark, tmp_path):
    folder = put(tmp_path, random.Random(1).randbytes(5000))
    assert rows(spark, folder, "1g") == []
    (tmp_path / "in" / "y.blob").write_bytes(b"")
    (tmp_path / "in" / "z.blob").write_bytes(codec.KEY)  # a key with nothing behind it is no blob
    (tmp_path / "in" / "w.blob").write_bytes(codec.KEY + b"abc")
    assert [x[1] for x in rows(spark, folder, "100")] == ["damaged"]


def test_written_by_spark(spark, tmp_path):
    blobs = made(12)
    df = spark.createDataFrame([(bytearray(b),) for b in blobs], "blob binary").repartition(3)
    scan.write(df, f"file://{tmp_path}/out")
    got = scan.scan(spark, f"file://{tmp_path}/out").collect()
    assert sorted((x.size, x.z_min) for x in got) == sorted((x[6], x[9]) for x in want(blobs, 0)) and {x.status for x in got} == {"ok"}
