"""Look-ups over the result tables: sources of a check, statistics, marks and entry-point edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.functions.text import joined_keys
from checkloom.operators.order import placed


def sources_of(checks: DataFrame, eps: list[str] | None = None, op1: str | None = None, op2: str | None = None) -> DataFrame:
    """(source, keys): source methods of a check in some entry points, with the databases that hold them."""
    x = checks
    if eps is not None:
        x = x.where(F.col("ep").isin(eps))
    if op1 is not None:
        x = x.where((F.col("op1") == op1) & F.col("op2").eqNullSafe(F.lit(op2)))
    return x.groupBy("source").agg(joined_keys(F.collect_set("key")).alias("keys"))


def statistics(eps: DataFrame, checks: DataFrame) -> DataFrame:
    """(n_stubs, stubs_with, n_eps, eps_with): stubs and entry points, those without checks included. eps: stub, ep."""
    have = checks.select("stub", "ep").distinct().withColumn("has", F.lit(1))
    x = eps.select("stub", "ep").distinct().join(have, ["stub", "ep"], "left")
    by = x.groupBy("stub").agg(F.count("*").alias("n"), F.count("has").alias("k"))
    return by.agg(F.count("*").alias("n_stubs"), F.sum((F.col("k") > 0).cast("long")).alias("stubs_with"), F.sum("n").alias("n_eps"), F.sum("k").alias("eps_with"))


def summary(uses: DataFrame) -> DataFrame:
    """(stub, ep, n): counts for each entry point, each stub and all: three levels in one pass."""
    return uses.rollup("stub", "ep").agg(F.count("*").alias("n"))


def pair_sources(checks: DataFrame) -> DataFrame:
    """(stub, op1, op2, n_sources, n_eps) with merged sources; sources are no part of a pair's identity."""
    return checks.groupBy("stub", "op1", "op2").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("ep").alias("n_eps"))


def marks(table: DataFrame, ep: str | None = None, source: str | None = None, kind: str | None = None, with_depth: DataFrame | None = None) -> DataFrame:
    """Marks (ep, source, unit, kind) under any filters; with their depths (ep, source, depth) if given. Empty when there
    are none: contains and hasData are `not isEmpty()`."""
    x = table
    for c, v in (("ep", ep), ("source", source), ("kind", kind)):
        x = x if v is None else x.where(F.col(c) == v)
    return x if with_depth is None else x.join(with_depth, ["ep", "source"], "left")


def units(table: DataFrame, *by: str) -> DataFrame:
    """Statements by any of ep, source, kind."""
    return table.groupBy(*by).agg(F.sort_array(F.collect_set("unit")).alias("units"))


def ep_edges(edges: DataFrame, kind: str = "any", what: str = "reference", ep: str | None = None, reference: str | None = None, source: str | None = None, unit: int | None = None) -> DataFrame:
    """Edges between entry points (ep, ref_ep, type, source, unit, depth): type internal, external or any (an edge of
    type both is either), filtered, projected to reference, source, unit or depth."""
    x = edges if kind == "any" else edges.where(F.col("type").isin(kind, "both"))
    for c, v in (("ep", ep), ("ref_ep", reference), ("source", source), ("unit", unit)):
        x = x if v is None else x.where(F.col(c) == v)
    columns = {"reference": ["ep", "ref_ep"], "source": ["ep", "ref_ep", "source"], "unit": ["ep", "ref_ep", "source", "unit"], "depth": ["ep", "ref_ep", "source", "depth"]}
    return x.select(*columns[what]).distinct()


def edge_types(edges: DataFrame) -> DataFrame:
    """Edges with types merged: internal and external edges between the same entry points are both."""
    n = F.countDistinct("type")
    return edges.groupBy("ep", "ref_ep").agg(F.when((n > 1) | F.bool_or(F.col("type") == "both"), "both").otherwise(F.min("type")).alias("type"))


def context_queries(table: DataFrame, ep: str | None = None) -> DataFrame:
    """Context queries (ep, cq, method), of one entry point or all."""
    return (table if ep is None else table.where(F.col("ep") == ep)).select("cq").distinct()


def in_subgraph(methods: DataFrame, table: DataFrame) -> DataFrame:
    """Methods (ep, method) in the subgraph of some context query of their entry point."""
    return methods.join(table.select("ep", "method"), ["ep", "method"], "left_semi")


def split_sizes(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the size of their key's group: singletons and groups in one pass."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("group_size")), key)


def ranked_methods(methods: DataFrame) -> DataFrame:
    """Methods (method, n_eps, checks, depth) in order, with their place, by entry points falling, average checks falling,
    average depth rising, method."""
    return placed(methods, F.col("n_eps").desc(), F.col("checks").desc(), F.col("depth").asc(), F.col("method")).orderBy("place")


def large_files(files: DataFrame, least: int) -> DataFrame:
    """(path, ep): files (path, length, text) of over `least` bytes and the entry point that their comment names."""
    return files.where(F.col("length") > least).select("path", F.regexp_extract("text", r"<!--\s*(<[^>]*>)", 1).alias("ep"))


def list_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, name): what one list has more often than the other."""
    return a.exceptAll(b).select(F.lit("first").alias("side"), "name").union(b.exceptAll(a).select(F.lit("second"), "name"))


def invoke_signatures(nodes: DataFrame) -> DataFrame:
    """(target, n): called signatures and how often."""
    return nodes.where("kind = 'invoke'").groupBy("target").agg(F.count("*").alias("n"))


def predicates_by_kind(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n_eps, n): control predicates by the kind of their statement."""
    return starts.join(nodes.select("ep", F.col("node").alias("start"), "kind"), ["ep", "start"]).groupBy("kind").agg(F.countDistinct("ep").alias("n_eps"), F.count("*").alias("n"))
