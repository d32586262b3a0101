"""Connected components of a table of links, by alternating large and small stars, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Links of each node's larger (or smaller) neighbours, and of itself, to its least neighbour.

    A large star's least neighbours are stored, so that both sides of the join come from plain exchanges and adaptive execution
    can split the rows of a hot center.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        out = both.join(common.keep(least, name), "u")
        return out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    out = both.join(least, "u")
    return out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link, and no smaller end is a larger one: each component is a star around its least node."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root of every node with a link: root is the least node that it reaches. edges: a long, b long; null ends are no links.

    Each round is stored in the shared folder, and the one before deleted. Stars of hot nodes combine before the shuffle, and the number
    of rounds grows with the logarithm of the longest path.
    """
    now = common.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    while not _are_stars(now):
        after = common.keep(_star(_star(now, True, name), False, name), name)
        common.drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
