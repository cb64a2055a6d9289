"""Sharding by a hierarchical weighted hash tree.

The tree has three levels (region, rack, shard). A row descends it: at each level every child draws
``-ln(u) / weight`` with ``u`` a hash of (key, child's name, seed) in (0, 1), and the smallest draw wins. A child
wins with probability weight / sum of weights, and its draw does not depend on its siblings: when weights change,
rows move only to or from the children whose weights changed, and below all other children nothing moves.

``grown`` adds a shard as a region of its own. No weight inside any other region changes, so a row either goes to the
new shard or stays where it was. (A shard added inside an existing rack moves rows only among the subtrees on its
path, but inside those they may also go to its siblings; ``add_to_rack`` does that.)

Everything is DataFrame expressions; the text never moves, only (id, size, checksum) rows are shuffled, by
(bucket of the id, shard), so that neither a hot shard nor a hot source fills one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, written

#: Rows of one numbering group (bucket of ids) on average.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """``regions``: name -> racks; a rack: name -> shards; a shard: number -> weight (all as tuples of pairs)."""

    regions: tuple
    seed: int = 7

    @staticmethod
    def of(n_shards: int, racks: int = 2, per_rack: int = 4, seed: int = 7) -> Tree:
        """A regular tree: regions of ``racks`` racks of ``per_rack`` shards of weight 1, the last ones perhaps less."""
        regions = []
        for r0 in range(0, n_shards, racks * per_rack):
            in_region = []
            for k0 in range(r0, min(n_shards, r0 + racks * per_rack), per_rack):
                in_region.append((f"rack{k0 // per_rack}", tuple((s, 1.0) for s in range(k0, min(n_shards, k0 + per_rack, r0 + racks * per_rack)))))
            regions.append((f"region{len(regions)}", tuple(in_region)))
        return Tree(tuple(regions), seed)

    def shards(self) -> list[int]:
        return [s for _, racks in self.regions for _, shards in racks for s, _ in shards]

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, as a region of its own: only it receives rows."""
        s = max(self.shards(), default=-1) + 1
        return replace(self, regions=(*self.regions, (f"region+{s}", ((f"rack+{s}", ((s, weight),)),))))

    def add_to_rack(self, rack: str, weight: float = 1.0) -> Tree:
        s = max(self.shards(), default=-1) + 1
        return replace(self, regions=tuple((r, tuple((k, (*shards, (s, weight)) if k == rack else shards) for k, shards in racks)) for r, racks in self.regions))


def uniform(key: Column, node: str, seed: int) -> Column:
    """A hash of (key, node, seed) in the open interval (0, 1), of 53 bits."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(node), F.lit(seed)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def _winner(key: Column, seed: int, children: list[tuple[str, float, object]]) -> Column:
    """The value (third item) of the child with the smallest draw; children of weight 0 are never drawn."""
    live = [c for c in children if c[1] > 0]
    if len(live) == 1:
        return live[0][2]
    draws = [(-F.log(uniform(key, name, seed)) / F.lit(float(w)), v) for name, w, v in live]
    least = F.least(*[d for d, _ in draws])
    out = None
    for d, v in draws:
        out = F.when(d == least, v) if out is None else out.when(d == least, v)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a row with this key (bigint or string; null is a key of its own)."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    weight = lambda shards: sum(w for _, w in shards)
    regions = []
    for region, racks in tree.regions:
        down = []
        for rack, shards in racks:
            leaf = _winner(key, tree.seed, [(f"shard/{s}", w, F.lit(s)) for s, w in shards if w > 0]) if weight(shards) > 0 else F.lit(None)
            down.append((f"{region}/{rack}", weight(shards), leaf))
        total = sum(w for _, w, _ in down)
        if total > 0:
            regions.append((region, total, _winner(key, tree.seed, down)))
    if not regions:
        raise ValueError("a tree needs a shard of positive weight")
    return _winner(key, tree.seed, regions).cast("int")


def place(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with size, text_crc32, shard, slot and, if ``grown`` is given, its shard there.

    Nulls: a null text has size 1 and the checksum of the empty text; all rows with a null doc_id share one shard. Rows
    that repeat a doc_id share a shard and take different slots. Slots are gapless from 0 in each shard. An empty
    table gives an empty table. Columns of ``docs`` other than these two are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("bigint") + F.lit(1)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        (shard_of(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    rows = written(rows, "placed")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("b", F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.lit(3)), F.lit(buckets)))
    counts = rows.groupBy("shard", "b").count()
    # one row per (shard, bucket): a few for every BUCKET_ROWS rows
    from pyspark.sql import Window as W

    base = counts.select("shard", "b", (F.sum("count").over(W.partitionBy("shard").orderBy("b").rowsBetween(W.unboundedPreceding, -1))).alias("base"))
    local = rows.withColumn("k", F.row_number().over(W.partitionBy("shard", "b").orderBy("doc_id", "text_crc32", "size")))
    out = local.join(base, ["shard", "b"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.coalesce(F.col("base"), F.lit(0)) + F.col("k") - 1).cast("bigint").alias("slot"), "grown_shard")


SHARDS = 16


def op4_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 by the law ``key``."""
    tree = Tree.of(SHARDS)
    out = place(table(spark, sf_dir, "documents"), tree, tree.grown())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
