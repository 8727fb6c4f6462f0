"""Connected components by alternating large-star and small-star steps.

Each step is two shuffles over the edges, and the number of steps grows with the logarithm of the
component size, not with its diameter. A node of very many edges is dealt among tasks. Every round is cut
by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LIGHT, checkpointed, spread_join


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node but the roots of edges (u, v).

    Self-links, repeated and reversed edges and those with a null end change nothing; no edges give no rows.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, done = _stars(edges)
    while not done:
        edges = checkpointed(_small_star(_large_star(edges, n), n))
        n, done = _stars(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: each larger end once, and never a smaller end."""
    ends = edges.select("u", F.lit(1).alias("larger")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("larger")))
    each = ends.groupBy("u").agg(F.sum("larger").alias("larger"), F.count("*").alias("n"))
    many = F.sum(F.when((F.col("larger") > 0) & (F.col("n") > 1), 1).otherwise(0))
    n, odd = each.agg(F.coalesce(F.sum("larger"), F.lit(0)), F.coalesce(many, F.lit(0))).first()
    return n, not odd


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each neighbour larger than a node moves to the smallest of the node and its neighbours. u is the larger end."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "v")
    if n <= LIGHT:
        moved = edges.join(low.hint("merge"), "v", "left")
    else:
        moved = spread_join(edges, edges.groupBy("v").agg(F.count("*").alias("n")).join(low.hint("merge"), "v", "left"), ["v"], "n", n)
    return moved.select("u", F.coalesce("low", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """u (the larger end) and its smaller neighbours move to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    moved = spread_join(edges, low, ["u"], "n", n).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()
