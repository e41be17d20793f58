"""Extracts: keyset pages, snapshots, JSON lines and CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyset_page(df: DataFrame, time: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The page after a (time, key) cursor, newest first; the cursor is a filter that reaches the scan."""
    if not 0 < limit <= 10_000:
        raise ValueError("limit must be from 1 to 10000")
    if cursor:
        at, last = F.lit(cursor[0]).cast(df.schema[time].dataType), F.lit(cursor[1])
        df = df.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < last)))
    return df.orderBy(F.desc(time), F.desc(key)).limit(limit)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A feature or comment snapshot stored as parquet, JSON lines or CSV."""
    if fmt not in ("parquet", "json", "jsonl", "csv", "orc"):
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format("json" if fmt == "jsonl" else fmt).load(path)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs, maps and arrays as JSON text, for CSV."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(*[F.to_json(c.name).alias(c.name) if isinstance(c.dataType, nested) else F.col(c.name) for c in df.schema])


def export(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Write rows as JSON lines, CSV or parquet; nothing is collected."""
    w = (flatten_nested(df) if fmt == "csv" else df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def snapshot_vectors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A feature snapshot as one vector per key; missing features are 0."""
    return df.select(key, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("vector"))


def read_jdbc(spark: SparkSession, url: str, query: str, fetch_size: int = 1000, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A query on a database, read in batches; ``partition`` is (column, lower, upper, partitions)."""
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**options)
    if partition:
        column, lower, upper, n = partition
        r = r.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n)
    else:
        r = r.option("query", query)
    return r.load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", batch_size: int = 1000, **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batch_size).options(**options).mode(mode).save()


def load_plan(spark: SparkSession, path: str, profile: str) -> list[str]:
    """The datasets that a JSON plan file lists for a profile; an unknown profile is an error that names the known ones."""
    plan = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    profiles = plan.get("profiles", {})
    if profile not in profiles:
        raise ValueError(f"unknown profile {profile}; known are {sorted(profiles)}")
    return list(profiles[profile].get("datasets", []))
