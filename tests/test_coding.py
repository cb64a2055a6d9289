"""Coding steps as relations, against numpy and the codec, at the edges of their types."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.functions import bits
from tessellar.operators import costs, planes, prefix, streams
from tessellar.plans import coding
from tessellar.sources import rasters

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["float", "double"])
def test_fields_are_the_bits(spark, kind):
    real, whole = (np.float32, np.uint32) if kind == "float" else (np.float64, np.uint64)
    tiny = np.finfo(real)
    r = np.random.default_rng(2)
    values = [0.0, -0.0, 1.0, -1.0, np.inf, -np.inf, np.nan, tiny.max, -tiny.max, tiny.tiny, tiny.smallest_subnormal, -3 * tiny.smallest_subnormal, tiny.tiny - tiny.smallest_subnormal]
    values += [np.nextafter(real(2.0**k), real(s)) for k in range(-120, 121, 3) for s in (0, np.inf)] + [2.0**k for k in range(-148, 128)]
    x = np.concatenate([np.array(values, real), r.integers(0, np.iinfo(whole).max, 500, dtype=whole).view(real)])
    x = np.where(np.isnan(x), np.abs(real(np.nan)), x)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, z double")
    got = planes.with_fields(df, kind).withColumn("u", planes.packed(F.col("hi"), F.col("lo"), kind)).withColumn("back", planes.value_of(F.col("hi"), F.col("lo"), kind)).orderBy("i").collect()
    u = x.view(whole).astype(np.uint64)
    want = ((u & 0x7F800000) << np.uint64(1)) | (u >> np.uint64(31)) << np.uint64(23) | u & np.uint64(0x7FFFFF) if kind == "float" else u
    assert [g.u for g in got] == want.view(np.int64).tolist()
    back = np.array([g.back for g in got], real)
    assert (back.view(whole) == x.view(whole))[~np.isnan(x)].all() and np.isnan(back[np.isnan(x)]).all()


def test_codes_are_optimal_prefix_free_and_canonical(spark):
    r = random.Random(4)
    groups = [{7: 5}, {0: 1, 255: 1}, {i: 1 for i in range(256)}, {i: 2**i for i in range(40)}, {i: 10 for i in range(5)}]
    fib = [1, 1]
    while len(fib) < 45:
        fib.append(fib[-1] + fib[-2])
    groups += [dict(enumerate(fib)), dict(enumerate(fib[:33])), *({b: r.choice([1, 1, 2, 3, 50, 1000]) for b in r.sample(range(256), r.randint(2, 256))} for _ in range(20))]
    df = spark.createDataFrame([(g, b, n) for g, h in enumerate(groups) for b, n in h.items()], "g int, bin bigint, n bigint")
    lengths = prefix.code_lengths(df, ["g"])
    got, sizes = {}, {x.g: x for x in prefix.coded_bytes(lengths, ["g"]).collect()}
    for x in prefix.canonical_codes(lengths, ["g"]).collect():
        got.setdefault(x.g, {})[x.bin] = x
    for g, h in enumerate(groups):
        own, counts = got[g], np.array([h.get(b, 0) for b in range(256)])
        best = bits.code_lengths(counts)
        assert {b: x.n for b, x in own.items()} == h
        if len(h) == 1:
            assert own[7].length == 0 and own[7].code is None and sizes[g].bytes is None
            continue
        n = np.array([own[b].length if b in own else 0 for b in range(256)])
        assert sum(2.0 ** -x.length for x in own.values()) == 1
        if best is None:  # longer than decoders read
            assert n.max() > 32 and sizes[g].bytes is None and own[0].code is None
            continue
        assert (counts * n).sum() == (counts * best).sum() and n.max() <= best.max()
        assert [own[b].code for b in sorted(own)] == bits.canonical(n)[sorted(own)].tolist()
        words = sorted(format(x.code, f"0{x.length}b") for x in own.values())
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
        assert sizes[g].bytes == bits.prefix_size(counts, n)
        stretches = [(e - b + (256 if e <= b else 0), e > b, b) for b, e in zip(sorted(h), [max(h) + 1] + [x + 1 for x in sorted(h)])]
        assert (sizes[g].stretch, sizes[g].begin) == min((n, not straight, b) for n, straight, b in stretches)[::2]


def test_every_mode_occurs(spark):
    """On the given tables every mode of a band is somewhere the one to take."""
    found = set()
    for name in ("image_mode_bytes", "image_mode_floats", "image_mode_lossy", "image_mode_coarse"):
        for sf in ("sf0.001", "sf0.01"):
            found |= {x["mode"] for x in getattr(coding, name)(spark, f"/root/testdata/{sf}").collect()}
    assert found == {"empty", "constant", "raw", "tiles 8", "tiles 16", "value", "delta", "planes"}


def test_levels_stop_where_one_more_does_not_help(spark, monkeypatch):
    """A plane that is linear in the position takes a difference; noise takes none."""
    px = spark.range(128 * 128).select(
        F.lit(0).alias("band"), F.floor(F.col("id") / 128).alias("row"), (F.col("id") % 128).alias("col"),
        (1 + (F.pmod(F.col("id") * 37, F.lit(256)) + 256 * F.pmod(F.xxhash64("id"), F.lit(128))) / F.lit(8388608.0)).alias("z"),
    )
    none = spark.createDataFrame([(0, 0)], "band int, predictor bigint")
    got = planes.plane_levels(px, "float", none).collect()
    best = {x.plane: x.best for x in got}
    assert best[0] >= 1 and best[1] == 0 and {x.level for x in got} == set(range(6))
    monkeypatch.setattr(planes, "FEW_ROWS", 3)  # the sampled rows joined by a shuffle
    assert sorted(planes.plane_levels(px, "float", none).collect()) == sorted(got)
    small = planes.plane_levels(px.filter("row < 63"), "float", none).collect()
    assert {(x.plane, x.level, x.bytes, x.best) for x in small} == {(k, 0, 0, 0) for k in range(4)}


def _random_streams():
    r = random.Random(8)
    out = [bytes([5]), bytes([5, 5]), bytes([1, 2]), bytes(range(200)) * 3, bytes([9]) * 131, bytes([9]) * 258, bytes([9]) * 70_000 + bytes([1] * 4), bytes(r.choice([0, 255]) for _ in range(3000))]
    for _ in range(30):
        out.append(b"".join(bytes([r.randrange(3)]) * r.choice([1, 1, 1, 2, 3, 4, 5, 6, 128, 129, 130, 131]) for _ in range(r.randint(1, 80))))
    return out


@pytest.mark.parametrize("chunk", [8, 1 << 16])
def test_runs_as_the_coders_write_them(spark, monkeypatch, chunk):
    monkeypatch.setattr(streams, "CHUNK", chunk)
    data = _random_streams() if chunk > 8 else [x for x in _random_streams() if len(x) < 4000]
    df = spark.createDataFrame([(k, i, b) for k, x in enumerate(data) for i, b in enumerate(x)], "k int, pos bigint, byte bigint").repartition(4)
    for segments, encode, end in ((streams.rle_segments(df, ["k"]), bits.rle_encode, 2), (streams.packbits_segments(df, ["k"]), bits.packbits_encode, 0)):
        got = segments.collect()
        size = {x.k: x.bytes for x in streams.coded_size(segments, ["k"], end).collect()}
        assert [size[k] for k in range(len(data))] == [len(encode(x)) for x in data]
        for k, x in enumerate(data):
            own = sorted((s for s in got if s.k == k), key=lambda s: s.start)
            assert [s.start for s in own] == [sum(t.length for t in own[:i]) for i in range(len(own))] and sum(s.length for s in own) == len(x)
            assert all(set(x[s.start : s.start + s.length]) == {s.byte} for s in own if s.byte is not None)


@pytest.mark.parametrize("old", [False, True])
def test_stuffed_words_are_the_coders(spark, old):
    r = random.Random(5)
    blocks = [[r.randrange(1 << w) for _ in range(n - 1)] + [(1 << w) - 1] for w in (1, 2, 3, 7, 8, 13, 16, 24, 31, 32) for n in (1, 2, 5, 63, 64, 256)]
    df = spark.createDataFrame([(k, i, q) for k, b in enumerate(blocks) for i, q in enumerate(b)], "k int, i bigint, q bigint")
    words = streams.stuffed_words(df, ["k"], old)
    got = {}
    for x in words.collect():
        got.setdefault(x.k, {})[x.word] = x.value
    for k, b in enumerate(blocks):
        w = max(b).bit_length()
        raw = (bits.pack_old if old else bits.pack)(np.array(b, np.uint32), w)
        want = np.frombuffer(raw + bytes(-len(raw) % 4), "<u4")
        assert [got[k][i] for i in range(len(got[k]))] == want.tolist()
    back = {(x.k, x.i): x.q for x in streams.unstuffed(words, ["k"], old).collect()}
    assert back == {(k, i): q for k, b in enumerate(blocks) for i, q in enumerate(b)}


def test_checksum_of_ranges(spark):
    r = random.Random(6)
    blobs = [b"", b"\0", b"\xff", b"ab", b"abc", bytes(65535 * 2), b"\xff" * 70_001, *(r.randbytes(r.randint(1, 9000)) for _ in range(30))]
    df = spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(blobs)], "k int, data binary")
    for chunk in (2, 64, 4096):
        some = df if chunk > 2 else df.filter("octet_length(data) < 3000")
        got = {x.k: x.checksum for x in streams.fletcher32(some, ["k"], chunk=chunk).collect()}
        assert got == {k: bits.fletcher32(blobs[k]) for k in got} and len(got) >= 10
    skipped = {x.k: x.checksum for x in streams.fletcher32(df, ["k"], skip=3).collect()}
    assert skipped == {k: bits.fletcher32(x[3:]) for k, x in enumerate(blobs)}


def test_depth_differences_never_cost_more(spark):
    px = rasters.int_depths(spark, SF)
    plain = {(x.depth, x.bi, x.bj): x.bytes for x in costs.tile_costs(px, 0.5, "int").collect()}
    got = costs.depth_costs(px, "int").collect()
    assert {x.differs for x in got} == {True, False} and not any(x.differs for x in got if x.depth == 0)
    assert all(x.bytes < plain[x.depth, x.bi, x.bj] if x.differs else x.bytes == plain[x.depth, x.bi, x.bj] for x in got) and len(got) == len(plain)
    assert sum(x.differs for x in got if x.depth == 1) > len(got) / 5
