"""Merging rows into a keyed table without MERGE: joins, coalesce and ranked unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sides(target: DataFrame, incoming: DataFrame, keys: Sequence[str]):
    t, s = target.alias("t"), incoming.alias("s")
    cond = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    ids = [F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys]
    rest = [c for c in target.columns if c not in keys]
    return t.join(s, cond, "full_outer"), ids, rest


def upsert_overwrite(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace rows with the same key, nulls included; the others stay."""
    kept = target.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)


def upsert_keep_existing(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``coalesce(target, incoming)`` per column: existing values win."""
    joined, ids, rest = _sides(target, incoming, keys)
    return joined.select(*ids, *[F.coalesce(f"t.{c}", f"s.{c}").alias(c) for c in rest])


def upsert_prefer_incoming(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``coalesce(incoming, target)`` per column: incoming values win unless null."""
    joined, ids, rest = _sides(target, incoming, keys)
    return joined.select(*ids, *[F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in rest])


def upsert_greatest(target: DataFrame, incoming: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Incoming wins unless null, but ``level`` never falls; null levels count as 0."""
    joined, ids, rest = _sides(target, incoming, keys)
    pick = lambda c: F.greatest(F.coalesce(f"t.{c}", F.lit(0)), F.coalesce(f"s.{c}", F.lit(0))) if c == level else F.coalesce(f"s.{c}", f"t.{c}")
    return joined.select(*ids, *[pick(c).alias(c) for c in rest])


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only incoming rows with new keys are added; among equal new keys one stays."""
    return target.unionByName(incoming.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti"))


def remap_keys(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Surrogate keys of a merged source become those of the target: mapping (src, dst); rows without a match go."""
    return rows.join(mapping, rows[column] == mapping["src"], "inner").withColumn(column, F.col("dst")).drop("src", "dst")


def merge_best(parts: Sequence[DataFrame], key: str, score: Column, tie: Column) -> DataFrame:
    """The best-scored row of each key over all parts, ties to the first by ``tie``; rows without a key all stay."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy(key).orderBy(score.desc(), tie)
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def last_write_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Several versions of a row: the last in ``order`` stays."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
