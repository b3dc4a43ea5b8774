"""Connected components of an edge table by alternating large-star and small-star rounds.

Both steps only move minima: ``groupBy().agg(min)`` combines on the map side, so a hub with very many
neighbours never gathers in one task. Where a hub's edges meet its minimum, the minima are a written table, so that the
join is a plain shuffled join whose hot keys adaptive execution splits. After each round the edges are a written table, which cuts the
lineage; the number of rounds grows with the logarithm of the longest path. Rounds end when all edges are stars, which one
aggregation by node tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.llm.storage import drop, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """The next edges, and the path of the minima that they read."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), path


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end ``a`` has one edge only, and no root is another edge's larger end."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("up"), none.alias("down")).unionByName(edges.select(F.col("b").alias("node"), none.alias("up"), one.alias("down")))
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of ``edges``; nodes are any ordered type.

    Returns ``node, root``: one row for each node that has an edge to another node, with the smallest node
    reachable from it. Self-loops, repeated edges and rows with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, path = materialize(now, "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        large, minima = _large_star(now)
        after, new_path = materialize(_small_star(large), "edges")
        drop(spark, path)
        drop(spark, minima)
        now, path = after, new_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # A settled table is a star forest: each non-root node once, pointing at its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
