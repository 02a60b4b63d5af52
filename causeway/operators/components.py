"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.tables import written


def component_of(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each end of the links (a, b) reaches.

    Rounds of large and small stars: every node hands its larger neighbours, then its smaller
    ones, over to the smallest it knows. The rounds grow with the logarithm of the number of
    nodes, not with the diameter; they end as soon as the edges are stars, which links that
    are stars from the start never need. Minima are aggregated before they travel, and each
    round is written, so plans stay short and lost executors cost one round. It raises if
    ``max_rounds`` do not settle it, so that no unfinished labels are returned.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    for k in range(1, max_rounds + 1):
        if _are_stars(edges):
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = written(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), f"edges{k}")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: then that is its smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()
