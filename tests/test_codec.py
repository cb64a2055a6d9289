"""The blob format: round trips, a golden blob, damage."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.functions import bits, blob, floats, oldblob

SHAPES = [(1, 1, 1, 1), (1, 1, 9, 1), (1, 7, 9, 1), (1, 8, 8, 1), (2, 16, 17, 1), (1, 64, 64, 1), (2, 12, 9, 3)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(blob.TYPES), st.sampled_from(SHAPES), st.sampled_from(["all", "none", "random", "rows"]), st.sampled_from(["constant", "ramp", "noise", "two", "full"]), st.sampled_from([0.0, 0.5, 1e-3, 0.1, 10.0]), st.sampled_from([2, 3, 4, 5, 6]), st.integers(0, 2**32 - 1))
def test_round_trip(kind, shape, masking, content, error, version, seed):
    if shape[3] > 1 and version < 4:
        return
    rng, dt = np.random.default_rng(seed), np.dtype(kind)
    n = np.prod(shape)
    z = {"constant": lambda: np.full(shape, 7), "ramp": lambda: np.arange(n).reshape(shape) % 101, "noise": lambda: rng.integers(0, 100, shape) + (rng.random(shape) if dt.kind == "f" else 0), "two": lambda: rng.integers(0, 2, shape) * 50, "full": lambda: rng.standard_normal(shape) * 1e30 if dt.kind == "f" else rng.integers(np.iinfo(dt).min, np.iinfo(dt).max, shape, dtype=dt, endpoint=True)}[content]().astype(dt)
    mask = {"all": lambda: np.ones(shape[:3], bool), "none": lambda: np.zeros(shape[:3], bool), "random": lambda: rng.random(shape[:3]) < 0.7, "rows": lambda: np.broadcast_to((np.arange(shape[1]) % 3 > 0)[None, :, None], shape[:3])}[masking]()
    data = blob.encode(z, mask, error, version)
    got = blob.decode(data)
    assert (got.mask == mask).all() and got.values.dtype == dt
    x, y = z[mask].astype(np.float64), got.values[mask].astype(np.float64)
    bound = error if dt.kind == "f" else max(0.5, np.floor(error))
    if dt.kind == "f" and error and len(x) and (x == np.floor(x)).all():
        bound = max(0.5, np.floor(error))
    if dt.kind != "f" and bound == 0.5:
        bound = 0
    slack = 1e-7 * np.abs(x).max(initial=0) if dt.kind == "f" and error else 0
    assert np.abs(x - y).max(initial=0) <= 1.1 * bound + slack
    h = blob.info(data)
    assert h["blob_size"] == len(data) and h["n_bands"] == shape[0]


def test_golden_header_and_raw_sweep():
    """A version 5 blob laid out by hand: 1 x 2 pixels of depth 3, checksum by the format's rule."""
    z = np.array([13, 57, 68, 14, 59, 80], "u1").reshape(1, 1, 2, 3)
    data = blob.encode(z, None, 0, 5)
    h = blob.read_header(bits.Cursor(data))
    assert (h.version, h.n_rows, h.n_cols, h.n_depth, h.n_valid, h.kind, h.error) == (5, 1, 2, 3, 2, 1, 0.5)
    assert data[66:70] == b"\0\0\0\0" and data[70:76] == bytes([13, 57, 68, 14, 59, 80])  # no mask; minima, maxima
    assert data[76] == 1 and data[77:] == z.tobytes()
    assert bits.fletcher32(data[14:]) == h.checksum


def test_worked_block_sizes():
    """12 of 16 values in 1222.2943 .. 1280.8725 take 25 bytes at error 0.01 and 15 at 1.0."""
    z, mask = np.zeros((4, 4, 1), "<f4"), np.arange(16).reshape(4, 4) < 12
    z[mask, 0] = np.linspace(1222.2943, 1280.8725, 12)
    for error, size in ((0.01, 25), (1.0, 15)):
        h = blob.Info(n_rows=4, n_cols=4, error=error, kind=6)
        assert len(blob.tiles(z, mask, h)) == blob.tiles(z, mask, h, size_only=True) == size


def test_damage_is_found():
    z = np.random.default_rng(1).random((1, 20, 20, 1)).astype("<f4")
    data = bytearray(blob.encode(z, None, 0.01))
    for at in range(14, len(data), 37):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            blob.decode(bytes(broken))
    for n in (0, 5, 60, len(data) - 1):
        with pytest.raises(ValueError):
            blob.decode(bytes(data[:n]))


def test_nodata_and_nan():
    rng = np.random.default_rng(2)
    z = rng.random((2, 9, 11, 2)).astype("<f4")
    z[0, ::2, :, 0] = -9999
    z[0, 0, 0] = np.nan
    z[1, 3] = -9999
    got = blob.decode(blob.encode(z, None, 0.001, 6, [-9999.0, -9999.0]))
    assert not got.mask[0, 0, 0] and not got.mask[1, 3].any() and got.mask[0, 2, 1]
    assert (got.values[0, 2, :, 0] == -9999).all() and np.abs(got.values[0, 1] - z[0, 1]).max() <= 0.0011
    with pytest.raises(ValueError):
        w = z.copy()
        w[0, 1, 1, 0] = np.nan
        blob.encode(w, None, 0.1)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_byte_codecs(data, repeat):
    data = data * repeat
    assert bits.rle_decode(bits.Cursor(bits.rle_encode(data)), len(data)) == data
    assert bits.packbits_decode(bits.packbits_encode(data), len(data)) == data
    if data:
        assert floats.decode_plane(floats.encode_plane(np.frombuffer(data, np.uint8)), len(data)).tobytes() == data
    v = np.frombuffer(data, np.uint8).astype(np.uint32) * 12345
    for version in (2, 6):
        assert (bits.unstuff(bits.Cursor(bits.stuff(v, version)), len(v), version) == v).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=2, max_size=2000), st.integers(1, 40))
def test_prefix_code(values, squeeze):
    s = np.array(values) // squeeze
    counts = np.bincount(s, minlength=256)
    lengths = bits.code_lengths(counts)
    if lengths is None:
        return
    raw = bits.prefix_encode(s, lengths)
    assert len(raw) == bits.prefix_size(counts, lengths)
    assert (bits.prefix_decode(bits.Cursor(raw), len(s)) == s).all()


def test_float_planes_exact():
    rng = np.random.default_rng(3)
    for kind in ("<f4", "<f8"):
        for z in (rng.standard_normal((7, 9)), np.add.outer(np.arange(30), np.arange(41)) * 0.25, np.zeros((3, 3)), np.array([[np.inf, -np.inf, -0.0]])):
            z = z.astype(kind)
            assert floats.decode(bits.Cursor(floats.encode(z)), kind, *z.shape).tobytes() == z.tobytes()


def test_first_format():
    import struct

    z, valid = np.arange(12, dtype="<f4").reshape(3, 4), np.arange(12).reshape(3, 4) % 5 > 0
    mask = bits.rle_encode(np.packbits(valid.ravel()).tobytes())
    q = np.arange(12, dtype=np.uint32)[valid.ravel()]
    stuffed = bytes([4 | 2 << 6, len(q)]) + bits.pack_old(q, 4)
    body = bytes([1 | 2 << 6]) + struct.pack("b", 0) + stuffed
    data = blob.OLD_KEY + struct.pack("<4id", 11, 8, 3, 4, 0.5) + struct.pack("<3if", 0, 0, len(mask), 1.0) + mask + struct.pack("<3if", 1, 1, len(body), 11.0) + body
    got = blob.decode(data)
    assert (got.mask[0] == valid).all() and (got.values[0, :, :, 0][valid] == z[valid]).all()
    assert (oldblob.as_type(np.array([0.5, 1.4, -0.5]), "<i4") == [1, 1, 0]).all()


def test_raised_bound_and_noise_planes():
    r = np.random.default_rng(3)
    z = np.round(r.random((1, 40, 40, 1)) * 100, 1)
    plain, raised = blob.headers(blob.encode(z, None, 0.0))[0].error, blob.headers(blob.encode(z, None, 0.02))[0]
    assert plain == 0 and raised.error == 0.05  # multiples of 0.1: half of that step
    assert np.abs(blob.decode(blob.encode(z, None, 0.02)).values - z).max() <= 0.02
    base = (np.add.outer(np.arange(300), np.arange(300)) // 4 * 64)[None, :, :, None]
    noisy = (base + r.integers(0, 16, base.shape)).astype("<u2")
    h = blob.headers(blob.encode(noisy, None, 777))[0]
    assert h.error == 4  # noise from plane 3 down: 1 << 3 >> 1
    assert blob.headers(blob.encode(noisy[:, :60, :60], None, 777))[0].error == 0.5  # too few pixels to tell


def test_counted_sizes():
    r = np.random.default_rng(4)
    for kind in blob.TYPES:
        z = np.cumsum(r.integers(-3, 4, (2, 37, 45, 2)), axis=2).astype(kind)
        for mask, error, version in ((None, 0, 6), (r.random((2, 37, 45)) < 0.8, 0.5, 5), (None, 3, 4)):
            assert blob.encode(z, mask, error, version, size_only=True) == len(blob.encode(z, mask, error, version))
