"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.tables import written


def _forest(edges: DataFrame) -> bool:
    """Every node points once, and to a node that points nowhere."""
    if edges.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.join(roots, "a", "left_semi").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), where root is the smallest node reached.

    Roots themselves are among the nodes. Self-loops, repeated and null-ended edges are ignored.
    A round replaces edges by edges to smaller nodes: each node's larger neighbours, then its
    smaller ones, are tied to the least of them. The number of rounds grows with the logarithm of
    the longest path. Rows are only ever pre-aggregated minima and plain equi-joins, so a node
    with very many neighbours is split like any other skewed join key.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct()
    edges = written(edges, "edges")
    while not _forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
