"""Centroid clustering and vector codes against plain Python, and against their SQL."""

import glob
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from tessellar.llm import codebooks, integers, lloyd, queries

SF = "/root/testdata/sf0.001"


def usable(v, size):
    return v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)


def scaled(v, by):
    return [int(np.floor(float(np.float32(x)) * by)) for x in v]


def near(x, points):
    """(squared distance, index) of the nearest point, the lowest index of equally near ones."""
    return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), i) for i, p in enumerate(points))


def moved(points, xs, at):
    out = []
    for i, p in enumerate(points):
        own = [x for x, a in zip(xs, at, strict=True) if a == i]
        out.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else p)
    return out


def rows(size=64, n=300):
    r = random.Random(3)
    coarse = lambda: [r.choice([-0.5, -0.25, 0.0, 0.125, 0.25, 1.0]) for _ in range(size)]  # noqa: E731  many ties
    out = [(i, coarse() if i % 3 else [r.gauss(0, 0.3) for _ in range(size)], i % 4) for i in range(n)]
    out += [(n + i, out[5][1], None) for i in range(40)] + [(2**60 + 1, [0.1] * size, 9), (None, [0.2] * size, 9), (None, [0.2] * size, None), (7, out[7][1], 3)]
    broken = [0.5] * (size - 1)
    return out + [(900, None, 1), (901, [*broken, None], 1), (902, [*broken, float("nan")], 1), (903, [*broken, float("-inf")], 1), (904, [], 1), (905, broken, 1), (906, [*broken, 1.0, 1.0], 1)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in data], "vec_id bigint, embedding array<float>, label int, cluster string, id int").repartition(3)


def test_lloyd_as_brute_force(spark):
    data = rows()
    kept = [(i, scaled(v, 1024)) for i, v, _ in data if usable(v, 64)]
    key = lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1])
    centroids = [x for _, x in sorted(kept, key=key)[:8]]
    xs = [x for _, x in kept]
    for _ in range(10):
        centroids = moved(centroids, xs, [near(x, centroids)[1] for x in xs])
    last = [near(x, centroids) for x in xs]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, c, d, sum(e for e, k in last if k == c), sum(e for e, _ in last), digest[c]) for (i, _), (d, c) in zip(kept, last, strict=True)]
    got = [tuple(x) for x in lloyd.Lloyd(frame(spark, data)).assigned().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(kept)


@pytest.mark.parametrize("size", [64, 16])
def test_codes_as_brute_force(spark, size):
    data = rows(size)
    kept = [(i, scaled(v, 256), label) for i, v, label in data if usable(v, size)]
    order = sorted([(i is None, i or 0, v) for i, v, _ in data if usable(v, size)])
    w = size // 16
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(scaled(v, 256), p) for *_, v in order[:64]] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            xs = [cut(x, p) for _, x, _ in kept]
            books[p] = moved(books[p], xs, [near(x, books[p])[1] for x in xs])
    coded = [[near(cut(x, p), books[p]) for p in range(16)] for _, x, _ in kept]
    error = [sum(d for d, _ in c) for c in coded]
    by = {label: sum(e for e, (*_, k) in zip(error, kept, strict=True) if k == label) for *_, label in kept}
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    want = [(i, "".join(f"{k:02x}" for _, k in c), e, by[label], digest) for (i, _, label), c, e in zip(kept, coded, error, strict=True)]
    made = codebooks.Codebooks(frame(spark, data))
    assert made.digest() == digest and {x.label: x.label_error for x in made.label_errors().collect()} == {None if k is None else str(k): v for k, v in by.items()}
    frame(spark, data).write.parquet(at := str(spark.conf.get("spark.checkpoint.dir")) + f"/codes{size}/embeddings.parquet")
    for few in (codebooks.FEW_LABELS, 1):  # sums broadcast, and joined by label and salt
        old, codebooks.FEW_LABELS = codebooks.FEW_LABELS, few
        got = [tuple(x) for x in codebooks.op13_kd_tree_codes(spark, os.path.dirname(at)).collect()]
        codebooks.FEW_LABELS = old
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_tree_keeps_lower_index_of_ties():
    r = np.random.default_rng(5)
    for n, width, top in [(1, 1, 3), (64, 4, 3), (64, 4, 200), (64, 1, 5), (7, 2, 2), (64, 3, 1)]:
        points = r.integers(-top, top, (n, width))
        x = r.integers(-2 * top, 2 * top, (500, width))
        at, d = codebooks.Tree(points).nearest(x)
        far = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        assert (at == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    assert len(codebooks.Tree(r.integers(-200, 200, (64, 4))).axis) > 20  # it does split


def test_few_rows_and_none(spark):
    few = rows()[:3]
    got = lloyd.Lloyd(frame(spark, few)).assigned().collect()
    assert sorted(x.cluster for x in got) == [0, 1, 2] and {x.inertia for x in got} == {0}
    assert {x.error for x in codebooks.Codebooks(frame(spark, few)).coded().collect()} == {0}
    none = frame(spark, rows()[-6:])
    assert lloyd.Lloyd(none).assigned().count() == 0 and codebooks.Codebooks(frame(spark, [(1, [0.5] * 15, 1)])).coded().count() == 0


def test_blocks_cut_anywhere_and_too_large(spark, monkeypatch):
    data = [x for x in rows() if x[0] is not None]
    want = sorted(map(tuple, lloyd.Lloyd(frame(spark, data)).assigned().collect()))
    monkeypatch.setattr(integers, "BLOCK", 64)
    assert sorted(map(tuple, lloyd.Lloyd(frame(spark, data)).assigned().collect())) == want
    with pytest.raises(Exception, match="too large"):
        lloyd.Lloyd(frame(spark, [(1, [3e38] * 64, 1), (2, [0.0] * 64, 1)]))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.queries()[name](spark, SF)
    columns = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(con.execute(f"select {columns} from ({queries.oracle_sql()[name]})").fetchall())
