"""Connected components of a graph of numbered nodes, in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for all nodes of ``edges (a, b)``.

    A round joins the larger neighbours of every node to its smallest neighbour, then the
    smaller ones and the node itself.  No round gathers the neighbours of a node; the
    number of rounds grows with the logarithm of the longest path.
    """
    graph = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, F.col("b") > F.col("a"))
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        graph = written(_star(small, F.lit(True), own=True))
        # Two numbers tell whether the round changed anything.
        now = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = graph.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return found.unionByName(roots)


def _star(edges: DataFrame, chosen, own: bool = False) -> DataFrame:
    """Join the chosen neighbours of ``a`` to the smallest of them and ``a``."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = edges.join(least, "a").filter(chosen)
    pairs = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if own:
        pairs = pairs.unionByName(least.select("a", F.col("least").alias("b")))
    return pairs.filter("a <> b").distinct()
