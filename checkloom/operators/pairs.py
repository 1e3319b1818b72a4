"""The algebra of checks: unordered pairs, merged sources, the fixed order of simplifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.functions.predicates import pair
from checkloom.functions.values import unwanted, unwrap_boolean, unwrap_equals


def normalise(checks: DataFrame) -> DataFrame:
    p = pair(F.col("op1"), F.col("op2"))
    return checks.withColumn("_p", p).withColumn("op1", F.col("_p.op1")).withColumn("op2", F.col("_p.op2")).drop("_p")


def merge_sources(checks: DataFrame, *by: str) -> DataFrame:
    """One row for each pair with all its sources."""
    return normalise(checks).groupBy(*by, "op1", "op2").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def simplify(checks: DataFrame) -> DataFrame:
    """equals() is unwrapped, then boolean checks, then pairs that say nothing go; then pairs are normal and distinct."""
    e1, e2 = unwrap_equals(F.col("op1")), unwrap_equals(F.col("op2"))
    flag = lambda c: F.col(c).isin("0", "1")
    eq = F.when(flag("op2") | F.col("op2").isNull(), e1).when(flag("op1"), e2)
    x = checks.withColumn("_e", eq).withColumn("_a", F.coalesce("_e.op1", "op1")).withColumn("_b", F.when(F.col("_e").isNotNull(), F.col("_e.op2")).otherwise(F.col("op2")))
    call = unwrap_boolean(F.col("_a"), F.col("_b"))
    x = x.withColumn("_c", call).withColumn("op1", F.coalesce("_c", "_a")).withColumn("op2", F.when(F.col("_c").isNull(), F.col("_b"))).drop("_e", "_a", "_b", "_c")
    return normalise(x.where(~unwanted(F.col("op1"), F.col("op2")))).distinct()


def without_queries(checks: DataFrame, removed: DataFrame) -> DataFrame:
    """Checks whose first method reference is in the removal set (target) go."""
    first = F.regexp_extract(F.concat_ws(" ", "op1", "op2"), r"(<[^>]*\)>)", 1)
    return checks.withColumn("target", first).join(removed.select("target"), "target", "left_anti").drop("target")


def ambiguous(checks: DataFrame) -> DataFrame:
    return checks.groupBy("op1", "op2").agg(F.countDistinct("ep").alias("eps"))
