"""Connected components of a graph given as edges, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _is_forest_of_stars(stars: DataFrame) -> bool:
    """Whether every node hangs on one other node at most, and none that hangs has others hanging on it."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(stars.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.max("holds").alias("h")).where("n > 1 or (n = 1 and h = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type -> (node, component): the smallest node that can be reached.

    Each round hangs the larger neighbours of every node, and then its smaller ones, on the smallest of them; the
    number of rounds grows as the logarithm of the longest path at most squared. A node with very many neighbours
    is summed before the exchange (min), and the join with its minimum is one that Spark splits where skewed. Loops
    and repeated edges do no harm, and edges with a null end are dropped.
    """
    stars = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(stars, "stars")
    while not _is_forest_of_stars(stars):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        stars = written(small.where("a != b").distinct(), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
