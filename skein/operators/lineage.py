"""Roots and depths of parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialise


def lineage(rows: DataFrame, id_col: str, parent_col: str, max_level: int = 32) -> DataFrame:
    """(id, root, level) of every row, by pointer doubling: log2(max_level) joins, each on the id.

    Rows whose parent is missing are roots. Levels end at ``max_level``: deeper rows, and rows
    of a cycle, are left out, which is the feature. Each join reads the table that the one
    before wrote, as it stands on both of its sides; the joins end when nothing moves.
    """
    out = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(parent_col), F.col(id_col)).alias("root"), F.when(F.col(parent_col).isNull(), 0).otherwise(1).alias("level"))
    known = out.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    out = out.join(known, out.root == known._id, "left").select("id", F.when(F.col("_known"), F.col("root")).otherwise(F.col("id")).alias("root"), F.when(F.col("_known"), F.col("level")).otherwise(0).alias("level"))
    out = materialise(out, "lineage")
    step = 1
    while step < max_level and not out.filter("level >= " + str(step)).isEmpty():
        up = out.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("level").alias("_level"))
        out = out.join(up, out.root == up._id, "left").select("id", F.coalesce("_root", "root").alias("root"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"))
        out = materialise(out, "lineage")
        step *= 2
    return out.filter(F.col("level") <= max_level)
