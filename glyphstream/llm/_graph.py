"""Connected components by repeated contraction onto smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for the nodes of edges (x, y): comp is the smallest node of the component.

    Each round every node points to its smallest neighbour (or itself), pointers are jumped twice, and edges are renamed;
    edges inside a tree vanish, so the number of rounds grows with the logarithm of the longest chain. Joins are of kept tables, whose partitions
    can be split where one node is many others' target.
    """
    e = scratch.keep(edges.select("x", "y").where("x <> y").distinct())
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("x").alias("node"), F.col("y").alias("other")).union(e.select(F.col("y").alias("node"), F.col("x").alias("other")))
        p = scratch.keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
        for _ in range(2):
            up = p.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            last, p = p, scratch.keep(p.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
            scratch.drop(last)
        named = lambda d, c: d.join(p.select(F.col("node").alias(c), F.col("comp").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731,B023
        old, labels = labels, p if labels is None else scratch.keep(named(labels, "comp"))
        if labels is not p:
            scratch.drop(old)
        last, e = e, scratch.keep(named(named(e, "x"), "y").where("x <> y").select("x", "y").distinct())
        scratch.drop(last, p if labels is not p else None)
        scratch.tidy()
    return labels if labels is not None else e.select(F.col("x").alias("node"), F.col("y").alias("comp"))
