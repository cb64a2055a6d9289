"""Vector code compression: product codes, with a kd-tree over each codebook.

A vector is cut into equal consecutive parts; each part position has a codebook of entries, and a part's code is the index of the nearest
entry. Every round broadcasts a kd-tree of each codebook. A block of vectors descends to the leaf on its side of the splits, which bounds
each part's distance from above; then the tree's nodes are visited in order with those vectors whose distance to the node's box is *not
greater* than their bound: a node at an equal bound may hold an equally near entry with a lower index, and that one counts. Tasks add up
their parts by entry, and a ``groupBy`` merges these integer sums into the new entries.

Rounds keep nothing but the codebooks between them; each is one pass over the input's columns.

Rows whose vector is null or has null or non-finite components take no part. Codebooks are of one length: that of the usable vector with
the smallest id among those whose length is a positive multiple of the number of parts; vectors of other lengths have no code and are left
out too. Repeated rows count each (of equal ids the smaller components come first; null ids come last), fewer vectors than entries give as
many entries, no vector gives no row. Components beyond the range of 64-bit squared distances raise OverflowError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import ids, ids_of, scaled
from .lloyd import _floored
from .shared import n_parts, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 4
#: Labels whose sums are broadcast at most (about 4 MB); beyond, rows and sums meet in a shuffle by label and salt.
FEW_LABELS, SALTS = 100_000, 16


class Tree:
    """A kd-tree over integer points, as flat arrays; node 0 is the root, and a node's children follow it in visiting order.

    ``low``/``high``: the box of a node's points; ``axis``: the split's axis, -1 for a leaf; ``split``: points with a greater coordinate are on
    the right; ``begin``/``end``: a node's stretch of ``order``, the points' indexes (ascending within a leaf)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, nodes, order = points, [], []

        def build(at: np.ndarray) -> int:
            me, own = len(nodes), points[at]
            low, high = own.min(axis=0), own.max(axis=0)
            axis = int((high - low).argmax())
            nodes.append([-1, 0, 0, 0, len(order), 0, low, high])
            if len(at) > leaf and high[axis] > low[axis]:
                values = np.sort(own[:, axis])
                split = values[(len(at) - 1) // 2]
                if split == high[axis]:  # more than half are the largest: those below it go left
                    split = values[values < split][-1]
                left = own[:, axis] <= split
                nodes[me][:4] = axis, split, build(at[left]), build(at[~left])
            else:
                order.extend(at.tolist())
            nodes[me][5] = len(order)
            return me

        build(np.arange(len(points)))
        self.axis, self.split, self.left, self.right, self.begin, self.end = (np.array(c, np.int64) for c in list(zip(*nodes, strict=True))[:6])
        self.low, self.high = np.array([n[6] for n in nodes]), np.array([n[7] for n in nodes])
        self.order = np.array(order, np.int64)

    def _leaf(self, node: int, x: np.ndarray, of: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        mine, d_mine, at_mine = x[of], best[of], at[of]
        for entry in self.order[self.begin[node] : self.end[node]].tolist():
            d = mine - self.points[entry]
            d = np.einsum("ij,ij->i", d, d)
            better = (d < d_mine) | ((d == d_mine) & (entry < at_mine))
            d_mine, at_mine = np.where(better, d, d_mine), np.where(better, entry, at_mine)
        best[of], at[of] = d_mine, at_mine

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the nearest point (of equally near ones the lowest) and the squared distance."""
        node = np.zeros(len(x), np.int64)
        while True:
            on = np.flatnonzero(self.axis[node] >= 0)
            if not len(on):
                break
            here = node[on]
            node[on] = np.where(x[on, self.axis[here]] <= self.split[here], self.left[here], self.right[here])
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.points), np.int64)
        by = np.argsort(node, kind="stable")
        leaves, first = np.unique(node[by], return_index=True)
        for leaf, of in zip(leaves.tolist(), np.split(by, first[1:]), strict=True):
            self._leaf(leaf, x, of, best, at)

        home, stack = node, [(0, np.arange(len(x)))]
        while stack:
            k, of = stack.pop()
            mine = x[of]
            out = np.maximum(np.maximum(self.low[k] - mine, mine - self.high[k]), 0)
            of = of[np.einsum("ij,ij->i", out, out) <= best[of]]
            if not len(of):
                continue
            if self.axis[k] >= 0:
                stack += [(int(self.right[k]), of), (int(self.left[k]), of)]
            elif len(of := of[home[of] != k]):
                self._leaf(k, x, of, best, at)
        return at, best


class Codebooks:
    """Codebooks of the vectors of ``vectors`` (id, vector, label): ``entries[part, index]`` are integer arrays."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        if entries > 256:
            raise ValueError("a code is a byte: at most 256 entries")
        self.rows = vectors.select(*ids_of(id_column), F.col(vector).alias("embedding"), F.col(label).cast("string").alias("label"))
        self.spark, self.parts, self.scale = vectors.sparkSession, parts, scale
        usable = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        order = ("no_id", "id", "embedding")
        some = self.rows.filter(usable)
        one = some.orderBy(*order).limit(1).collect()
        self.size = len(one[0].embedding) if one else 0
        first = some.filter(F.size("embedding") == self.size).orderBy(*order).limit(entries).select("embedding").toPandas() if one else None
        start = next(scaled(iter([first]), "embedding", self.size, scale))[1] if one else np.zeros((0, 0), np.int64)
        self.entries = start.reshape(len(start), parts, -1).swapaxes(0, 1).copy() if one else np.zeros((parts, 0, 0), np.int64)
        for _ in range(rounds if one else 0):
            self._round()

    def _coder(self):
        """A function of the rows of a task to blocks: the frame, its integer vectors by part, codes and squared distances by part; and the broadcast to release."""
        sent = self.spark.sparkContext.broadcast([Tree(e) for e in self.entries if len(e)])
        parts, size, scale = self.parts, self.size, self.scale

        def coded(frames: Iterator[pd.DataFrame]):
            for frame, x in scaled(frames, "embedding", size, scale) if size else ():
                x = x.reshape(len(x), parts, -1)
                codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
                for p, tree in enumerate(sent.value):
                    codes[:, p], far[:, p] = tree.nearest(np.ascontiguousarray(x[:, p]))
                yield frame, x, codes, far

        return coded, sent

    def _round(self) -> None:
        coded, sent = self._coder()
        parts, n, width = self.entries.shape

        def summed(frames):
            count, total = np.zeros(parts * n, np.int64), np.zeros((parts * n, width), np.int64)
            for _, x, codes, _ in coded(frames):
                slot = (codes + np.arange(parts) * n).ravel()
                count += np.bincount(slot, minlength=parts * n)
                by = np.argsort(slot, kind="stable")
                found, first = np.unique(slot[by], return_index=True)
                total[found] += np.add.reduceat(x.reshape(-1, width)[by], first, axis=0)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"slot": some.astype(np.int32), "n": count[some], "total": list(total[some])})

        sums = self.rows.mapInPandas(summed, "slot int, n bigint, total array<bigint>")
        merged = sums.groupBy("slot").agg(F.sum("n"), *[F.sum(F.col("total")[i].cast("decimal(19,0)")) for i in range(width)]).collect()  # at most parts * entries rows
        for slot, count, *total in merged:
            self.entries[slot // n, slot % n] = [int(t) // count for t in total]
        sent.unpersist()

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def coded(self) -> DataFrame:
        """vec_id, label (as a string), code (hex, two digits a part) and error of every vector that takes part."""
        coded, _ = self._coder()

        def rows(frames):
            for frame, _, codes, far in coded(frames):
                text, wide = codes.astype(np.uint8).tobytes().hex(), 2 * codes.shape[1]
                yield pd.DataFrame({"vec_id": ids(frame), "label": frame["label"].to_numpy(), "code": [text[i : i + wide] for i in range(0, len(text), wide)], "error": far.sum(axis=1)})

        return self.rows.mapInPandas(rows, "vec_id bigint, label string, code string, error bigint")

    def label_errors(self) -> DataFrame:
        """label, label_error: the errors added up by label, in each task first; null is a label of its own."""
        return self.coded().groupBy("label").agg(F.sum("error").alias("label_error"))


def op13_kd_tree_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors of ``embeddings`` in 16 parts of 64 entries after two rounds, with their errors.

    The sums by label are broadcast where there are at most ``FEW_LABELS`` of them; beyond, they are joined by label and a salt of the id."""
    books = Codebooks(table(spark, sf_dir, "embeddings"))
    rows, sums = books.coded(), books.label_errors()
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    same = F.col("r.label").eqNullSafe(F.col("s.label"))
    if few:
        joined = rows.alias("r").join(F.broadcast(sums).alias("s"), same)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.alias("r").join(sums.alias("s"), same & (F.col("r.salt") == F.col("s.salt")))
    return joined.select("r.vec_id", "r.code", "r.error", "s.label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rows in DuckDB, every part against every entry of its codebook, for vectors of one length."""
    near = lambda r: f"""d{r} as materialized (select vec_id, p, min_by(k, (d, k)) as k, min(d) as d from
      (select v.vec_id, v.p, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{r} c using (p, j) group by all) group by vec_id, p)"""  # noqa: E731
    step = lambda r: f"""c{r + 1} as materialized (select c.p, c.k, c.j, coalesce(n.x, c.x) as x from c{r} c left join
      (select p, k, j, {_floored("sum(x)", "count(*)")} as x from v join d{r} using (vec_id, p) group by p, k, j) n using (p, k, j))"""  # noqa: E731
    usable = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)"
    return f"""with u as materialized (select vec_id, label, embedding, len(embedding) // {parts} as width from embeddings where {usable} and len(embedding) % {parts} = 0),
    v as materialized (select vec_id, i // width as p, i % width as j, x from (select vec_id, width, unnest(range(len(embedding))) as i, cast(floor({scale} * cast(unnest(embedding) as double)) as bigint) as x from u)),
    first as (select vec_id, row_number() over (order by vec_id) - 1 as k from u qualify k < {entries}),
    c0 as materialized (select p, k, j, x from v join first using (vec_id)),
    {", ".join(f"{near(r)}, {step(r)}" for r in range(rounds))}, {near(rounds)},
    coded as (select vec_id, string_agg(printf('%02x', cast(k as integer)), '' order by p) as code, cast(sum(d) as bigint) as error from d{rounds} group by vec_id),
    books as (select sha256(string_agg(cast(x as varchar), ',' order by p, k, j)) as codebooks_sha256 from c{rounds})
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join u using (vec_id), books"""
