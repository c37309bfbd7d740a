"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which something is wrong (each at least halves long chains).
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b)
    reaches.  Alternates large-star and small-star steps: every step is a
    grouped minimum and a join, so a hub's edges are never gathered in one
    row; each round is a table in the shared folder, so lost executors cost a
    re-read only."""
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "edges")
    for _ in range(MAX_ROUNDS):
        # Large star: each larger neighbour goes to the smallest of the closed
        # neighbourhood.
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.c).where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every node's smaller neighbours, and the node, go to the
        # smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(low, large.u == low.c)
        small = (joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select(F.col("c").alias("u"), F.col("m").alias("v")))).distinct()
        new = materialize(small, "edges")
        same = new.count() == pairs.count() and new.exceptAll(pairs).limit(1).count() == 0
        pairs = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
