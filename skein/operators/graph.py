"""Typed graphs of creators, videos and tags: edges and strengths; walks and vectors stand in ``walks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.walks import node_vectors, random_walks  # noqa: F401


def edge_weight(age_days: Column, missing: Column, interactions: Column, half_life: float = 45.0) -> Column:
    """Recency times quality (0.05 less per missing field, 0.5 at least) times interaction. The numbers are fixed values."""
    return F.pow(F.lit(2.0), -age_days / half_life) * F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - 0.05 * missing)) * (1 + 0.15 * F.log1p(interactions))


def undirected(edges: DataFrame, src: str, dst: str, kind: str, weight: str) -> DataFrame:
    """One row per unordered pair and type with the sum of weights."""
    return edges.groupBy(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), F.col(kind).alias("kind")).agg(F.sum(weight).alias("weight"))


def node_strength(edges: DataFrame) -> DataFrame:
    """Weighted degree of each node, and its share of the largest."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    s = ends.groupBy("id").agg(F.sum("weight").alias("strength"), F.count("*").alias("degree"))
    return s.crossJoin(F.broadcast(s.agg(F.max("strength").alias("_top")))).withColumn("normalised", F.col("strength") / F.greatest("_top", F.lit(1e-12))).drop("_top")


def annotate(rows: DataFrame, key: str, strengths: DataFrame) -> DataFrame:
    """Rows with their node's normalised strength, 0 where it has none."""
    return rows.join(strengths.select(F.col("id").alias(key), F.col("normalised").alias("graph_strength")), key, "left").fillna(0.0, ["graph_strength"])
