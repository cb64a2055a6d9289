"""Centroid clustering: Lloyd's algorithm in integers.

Every round broadcasts the centroids, and ``mapInPandas`` computes the squared differences to each of them in NumPy; the first of equal
distances wins. A task adds up its vectors and their number for each centroid and gives one row a centroid, which a ``groupBy`` merges, so
that ``k`` rows reach the driver. Sums are exact, so the result depends neither on partitions nor on their order.

A round is one pass over the two columns of the input and keeps nothing between rounds but the centroids: a lost executor costs its tasks.

Rows whose vector is null, has another number of components than ``size``, or has null or non-finite ones take no part. Repeated rows
count each; among starting vectors with equal hashes (equal ids) the one with the smaller components comes first, null ids come last.
Fewer vectors than ``k`` give as many centroids; no vector gives no row. Components beyond the range of 64-bit squared distances raise
OverflowError. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import ids, ids_of, scaled
from .shared import table

SIZE, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the number of its nearest centroid (of equally near ones the smallest) and the squared distance."""
    far = np.empty((len(centroids), len(x)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        far[k] = np.einsum("ij,ij->i", d, d)
    at = far.argmin(axis=0)
    return at, far[at, np.arange(len(x))]


class Lloyd:
    """``rounds`` rounds over the integer vectors of ``vectors`` (id, vector); ``centroids`` are the final ones, ``inertia`` each one's sum of squared distances."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED):
        self.rows = vectors.select(*ids_of(id_column), F.col(vector).alias("embedding"))
        self.spark, self.size, self.scale = vectors.sparkSession, size, scale
        self.centroids = self._first(k, seed)
        for _ in range(rounds if len(self.centroids) else 0):
            for c, n, total, _ in self._totals():
                self.centroids[c] = [t // n for t in total]  # exact, towards minus infinity
        self.inertia = {c: far for c, _, _, far in self._totals()} if len(self.centroids) else {}

    def _first(self, k: int, seed: int) -> np.ndarray:
        size, scale = self.size, self.scale

        def usable(frames):
            for frame, x in scaled(frames, "embedding", size, scale):
                yield pd.DataFrame({"vec_id": ids(frame), "x": list(x)})

        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
        first = self.rows.mapInPandas(usable, "vec_id bigint, x array<bigint>").orderBy(key.asc_nulls_last(), "x").limit(k)
        return np.array([r.x for r in first.select("x").collect()], np.int64).reshape(-1, size)

    def _totals(self) -> list[tuple[int, int, list[int], int]]:
        """For each centroid with vectors: its number, how many, their sum in each component, and the sum of squared distances."""
        sent = self.spark.sparkContext.broadcast(self.centroids)
        size, scale = self.size, self.scale

        def summed(frames):
            now = sent.value
            n, total, far = np.zeros(len(now), np.int64), np.zeros((len(now), size), np.int64), np.zeros(len(now), np.int64)
            for _, x in scaled(frames, "embedding", size, scale):
                at, d = nearest(x, now)
                for c in np.unique(at).tolist():
                    of = at == c
                    n[c] += of.sum()
                    total[c] += x[of].sum(axis=0)
                    far[c] += d[of].sum()
            some = np.flatnonzero(n)
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some]), "far": far[some]})

        wide = lambda c: F.sum(c.cast("decimal(19,0)"))  # noqa: E731  exact where 64 bits would end
        parts = self.rows.mapInPandas(summed, "cluster int, n bigint, total array<bigint>, far bigint")
        merged = parts.groupBy("cluster").agg(F.sum("n"), *[wide(F.col("total")[i]) for i in range(size)], wide(F.col("far"))).collect()
        sent.unpersist()
        return [(r[0], r[1], [int(v) for v in r[2:-1]], int(r[-1])) for r in merged]

    def assigned(self) -> DataFrame:
        """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
        size, scale, now, inertia = self.size, self.scale, self.centroids, self.inertia
        digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now], object)
        own = np.array([inertia.get(c, 0) for c in range(len(now))], np.int64)
        everything = sum(inertia.values())
        if everything >= 1 << 63:
            raise OverflowError("the inertia does not fit a 64-bit integer")

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame, x in scaled(frames, "embedding", size, scale) if len(now) else ():
                at, d = nearest(x, now)
                yield pd.DataFrame({"vec_id": ids(frame), "cluster": at.astype(np.int32), "distance": d, "cluster_inertia": own[at], "inertia": everything, "centroid_sha256": digests[at]})

        return self.rows.mapInPandas(rows, "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")


def op12_plain_lloyd(spark, sf_dir: str) -> DataFrame:
    """Ten rounds of Lloyd's algorithm over all 64-component vectors of ``embeddings``: each vector's cluster, distance and its centroid's digest."""
    return Lloyd(table(spark, sf_dir, "embeddings")).assigned()


def _floored(total: str, n: str) -> str:
    return f"(({total} - (({total} % {n}) + {n}) % {n}) // {n})"


def sql(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rows in DuckDB: one relation of (vector, component), one of (centroid, component), joined and grouped each round."""
    near = lambda r: f"""d{r} as materialized (select vec_id, min_by(k, (d, k)) as k, min(d) as d from
      (select v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{r} c using (j) group by all) group by vec_id)"""  # noqa: E731
    step = lambda r: f"""c{r + 1} as materialized (select c.k, c.j, coalesce(n.x, c.x) as x from c{r} c left join
      (select k, j, {_floored("sum(x)", "count(*)")} as x from v join d{r} using (vec_id) group by k, j) n using (k, j))"""  # noqa: E731
    usable = f"embedding is not null and len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size}"
    return f"""with v as materialized (select vec_id, unnest(range({size})) as j, cast(floor({scale} * cast(unnest(embedding) as double)) as bigint) as x from embeddings where {usable}),
    first as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as k from (select distinct vec_id from v) qualify k < {k}),
    c0 as materialized (select k, j, x from v join first using (vec_id)),
    {", ".join(f"{near(r)}, {step(r)}" for r in range(rounds))}, {near(rounds)},
    named as (select k, sha256(string_agg(cast(x as varchar), ',' order by j)) as centroid_sha256 from c{rounds} group by k)
    select vec_id, cast(k as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia,
      cast(sum(d) over () as bigint) as inertia, centroid_sha256 from d{rounds} join named using (k)"""
