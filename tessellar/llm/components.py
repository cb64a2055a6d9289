"""Connected components by repeated contraction, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label for every node of ``edges`` (a, b bigint): the label is the smallest node of its component.

    Each round every node points to its smallest neighbour (or itself), pointers are followed once more, and the edges are
    mapped to what their ends point to. At least half of the nodes with an edge go away in a round, so there are about log(n) rounds;
    each is written to the shared folder. Self-loops make a node known without linking it."""
    spark = edges.sparkSession
    e = written(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct(), name, few=True)
    labels = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), name, few=True)
        twice = point.select(F.col("a").alias("node"), F.col("p").alias("up")).join(point.select(F.col("a").alias("up"), F.col("p").alias("label")), "up").select("node", "label")
        step = written(twice, name, few=True)
        if labels is None:
            new = step
        else:
            new = written(labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), name, few=True)
        s = step.select(F.col("node").alias("a"), F.col("label").alias("x"))
        t = step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        left = written(e.join(s, "a").join(t, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name, few=True)
        drop(e, point, *([labels, step] if labels is not None else []))
        labels, e = new, left
        if e.isEmpty():
            drop(e)
            return labels
