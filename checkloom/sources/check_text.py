"""Check files: one line for each entry point, `` `ep`; `op`; {`op1`, `op2`} ``, and the dumps made from checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checkloom.functions.predicates import pair, pair_text

ELEMENT = r"\{[^}]*\}|`[^`]*`"


def parse_checks(lines: DataFrame) -> DataFrame:
    """(stub, ep, pos, op1, op2) of lines (stub, value); pos counts from 1. An entry point without checks has one row
    with null pos and operands. A line that isn't of the form is an error."""
    ok = F.col("value").rlike(r"^\s*`[^`]*`(\s*;\s*(`[^`]*`|\{\s*`[^`]*`\s*,\s*`[^`]*`\s*\}))*\s*;?\s*$")
    text = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed check line: "), F.col("value"))))
    parts = F.regexp_extract_all(text, F.lit(f"({ELEMENT})"), F.lit(1))
    rows = lines.where(F.trim("value") != "").select("stub", parts.alias("parts"))
    rows = rows.select("stub", F.regexp_replace(F.col("parts")[0], "`", "").alias("ep"), F.posexplode_outer(F.slice("parts", 2, F.size("parts"))).alias("i", "part"))
    ops = F.regexp_extract_all("part", F.lit("`([^`]*)`"), F.lit(1))
    p = pair(F.get(ops, F.lit(0)), F.get(ops, F.lit(1)))
    return rows.select("stub", "ep", (F.col("i") + 1).alias("pos"), p["op1"].alias("op1"), p["op2"].alias("op2"))


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Check files under `path`; the stub is the file's name without extension."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_checks(lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stub"), "value"))


def check_column() -> Column:
    return pair_text(F.struct("op1", "op2"))


def check_lines(checks: DataFrame) -> DataFrame:
    """(stub, value): a line for each entry point, checks in text order."""
    c = F.sort_array(F.collect_set(F.when(F.col("op1").isNotNull(), check_column())))
    return checks.groupBy("stub", "ep").agg(c.alias("c")).select("stub", F.concat_ws("; ", F.concat(F.lit("`"), F.col("ep"), F.lit("`")), F.array_join("c", "; ")).alias("v"), "c").select("stub", F.when(F.size("c") == 0, F.regexp_replace("v", "; $", "")).otherwise(F.col("v")).alias("value"))


def write_checks(checks: DataFrame, path: str) -> None:
    """One directory for each stub."""
    check_lines(checks).write.partitionBy("stub").mode("error").text(path)


def by_source(checks: DataFrame, *outer: str) -> DataFrame:
    """(*outer, sources): pairs by statement by source method, nested and sorted: the grouped dumps with and without
    the entry point."""
    one = checks.groupBy(*outer, "source", "stmt").agg(F.sort_array(F.collect_set(check_column())).alias("checks"))
    two = one.groupBy(*outer, "source").agg(F.sort_array(F.collect_list(F.struct("stmt", "checks"))).alias("stmts"))
    return two.groupBy(*outer).agg(F.sort_array(F.collect_list(F.struct("source", "stmts"))).alias("sources")) if outer else two


def by_ep(checks: DataFrame) -> DataFrame:
    return checks.groupBy("ep").agg(F.sort_array(F.collect_set(check_column())).alias("checks"))


def distinct_pairs(checks: DataFrame) -> DataFrame:
    return checks.select(check_column().alias("check")).distinct().orderBy("check")


def members(uses: DataFrame, *by: str) -> DataFrame:
    """Methods or fields used, overall or by entry point. uses: ep, member."""
    return uses.select("member").distinct() if not by else uses.groupBy(*by).agg(F.sort_array(F.collect_set("member")).alias("members"))


def features(checks: DataFrame) -> DataFrame:
    """(ep, items): present checks only; the absent half of a feature vector is never made."""
    same = F.coalesce(F.col("op1") == F.col("op2"), F.lit(False))
    return checks.groupBy("ep").agg(F.sort_array(F.collect_set(F.when(F.col("op1").isNotNull() & ~same, check_column()))).alias("items"))


def parse_features(lines: DataFrame) -> DataFrame:
    """(ep, items) of comma-separated feature lines (value): label first, tokens `N_..` dropped."""
    t = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.select(t[0].alias("ep"), F.sort_array(F.filter(F.slice(t, 2, F.size(t)), lambda x: ~F.startswith(x, F.lit("N_")) & (x != ""))).alias("items"))
