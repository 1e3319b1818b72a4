"""Incremental recompute: manifests of inputs, their differences, and a streaming view of check files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkloom.sources.check_text import parse_checks


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of the files under `path`."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("hash"))


def table_manifest(df: DataFrame, key: str) -> DataFrame:
    """(key, hash): an order-free hash for each key's rows."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(key).agg(F.sum(row).cast("string").alias("hash"))


def changes(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(key, change): added, removed or changed entries; none means that a stage can be skipped."""
    o, n = old.select(key, F.col("hash").alias("before")), new.select(key, F.col("hash").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return o.join(n, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select(key, change.alias("change"))


def needed(old: DataFrame, new: DataFrame, key: str = "path") -> bool:
    return not changes(old, new, key).isEmpty()


def stream_checks(spark: SparkSession, path: str) -> DataFrame:
    """Check files as they arrive: a streaming table like read_checks gives."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", "true").text(path)
    return parse_checks(lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stub"), "value"))
