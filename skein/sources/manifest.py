"""Content-addressed bundles: partitioned parquet and a manifest with a hash per entity."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> dict:
    """Rows and an order-free hash of the content: sums of two halves of each row's hash, in one aggregate."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), half(1), half(16)).first()
    return {"rows": n, "hash": f"{int(a or 0):x}-{int(b or 0):x}", "schema": df.schema.simpleString()}


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_bundle(bundle: dict[str, DataFrame], root: str, version: str, partition_by: str = "source") -> str:
    """Write every entity below a folder named by the content, once; returns the folder.

    An existing folder with a manifest is returned as it is, so a replay changes nothing.
    """
    spark = next(iter(bundle.values())).sparkSession
    entities = {name: content_hash(df) for name, df in sorted(bundle.items())}
    ident = spark.range(1).select(F.sha2(F.lit(json.dumps([version, entities], sort_keys=True)), 256)).first()[0][:16]
    folder = f"{root}/{version}-{ident}"
    fs, marker = _files(spark, f"{folder}/manifest.json")
    if fs.exists(marker):
        return folder
    for name, df in bundle.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by in df.columns else w).parquet(f"{folder}/{name}")
    out = fs.create(marker, True)
    out.write(bytearray(json.dumps({"version": version, "id": ident, "entities": entities}, sort_keys=True).encode()))
    out.close()
    return folder


def read_bundle(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The entities of a bundle; with ``verify`` their content and schema must match the manifest."""
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect()))
    out = {}
    for name, want in manifest["entities"].items():
        df = spark.read.parquet(f"{folder}/{name}")
        names = [f.split(":", 1)[0] for f in want["schema"].removeprefix("struct<").split(",")] if want["schema"].count("<") == 1 else None
        if names and set(names) == set(df.columns):
            df = df.select(*names)
        if verify:
            got = content_hash(df)
            if (got["rows"], got["hash"]) != (want["rows"], want["hash"]):
                raise ValueError(f"{name} does not match its manifest")
        out[name] = df
    return out


def append_run(spark: SparkSession, path: str, **record) -> None:
    """One line in an append-only registry of runs."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "record string").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of rows that have each feature, for a snapshot's manifest."""
    a = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in features])
    return a.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("coverage")) for c in features])).alias("f")).select("f.*", "n")
