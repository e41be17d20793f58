"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, materialise


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links go from larger to smaller here: a node's smaller neighbours and itself are linked to the smallest."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (a, b); the component is its smallest node.

    Each round is two joins and two aggregates over the links, written to the shared folder;
    the rounds grow with the logarithm of the longest chain. Nothing of them reaches the driver.
    """
    rows = links.count()
    e = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links", rows)
    while not _is_forest_of_stars(e):
        new = materialise(_small_star(_large_star(e)), "links", rows)
        discard(e)
        e = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every node that has a smaller one has just that one, and that one has none."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
