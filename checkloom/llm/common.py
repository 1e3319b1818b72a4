"""Shared helpers: table reading, documents meeting what was found for them, cuts in the shared folder, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkloom.operators.graph import components
from checkloom.plans.shared import cut

__all__ = ["components", "cut", "meet", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meet(docs: DataFrame, found: DataFrame, column: str, name: str) -> DataFrame:
    """row (the columns of `docs` but text, as a struct), text, and `column` of `found` (doc_id, text_hash) under `name`, null where
    it has none. Rows of `docs` that share doc_id and text share what is found; columns of any name do no harm."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    x = docs.select(whole, F.col("text"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    f = found.select(F.col("doc_id").alias("fd"), F.col("text_hash").alias("fh"), F.col(column).alias(name))
    return x.join(f, F.col("d").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh")), "left").select("row", "text", name)
