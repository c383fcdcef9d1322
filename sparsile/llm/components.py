"""Connected components of an edge table, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.session import durable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Alternates two steps that hang neighbours below smaller nodes: every larger neighbour of a node below the node's
    least one, then every smaller neighbour and the node itself.  Trees flatten to stars in a logarithmic number of
    rounds; each round is written to the shared folder.
    """
    edges = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v").distinct()
        edges = durable(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("u"), "root").distinct())
