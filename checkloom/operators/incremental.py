"""Closures that are kept while edges change: only what a change can touch is looked at again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkloom.operators.graph import REACH_CUT, reach
from checkloom.plans.shared import bucketed, cut


def kept_closure(before: DataFrame, edges: DataFrame, inserted: DataFrame, deleted: DataFrame, seeds: DataFrame, table: bool = False) -> DataFrame:
    """(ep, node): the closure of `seeds` (ep, node) over `edges` without `deleted` and with `inserted` (all src, tgt), from the
    closure `before` (ep, node) over `edges`; what a full closure gives.

    First all nodes behind a deleted edge are in doubt, for the entry points that had its source. Those of them that an edge
    which is still there leads to from a node without doubt (or that are seeds) are safe after all, and so is what they lead to;
    the rest goes. Then inserted edges grow the closure from where they begin. Only doubtful and new nodes move, so a small
    change costs little, however large the closure is; `before` itself is joined by node, never rebuilt. table: as in `reach`.
    """
    before = before.select("ep", "node")
    gone, inserted = cut(deleted.select("src", "tgt").distinct(), "gone"), cut(inserted.select("src", "tgt").distinct(), "inserted")
    edges = edges.select("src", "tgt") if table else bucketed(edges.select("src", "tgt"), "src", label="edges")
    # an inserted edge that was there already comes twice, which no step minds
    now = cut(edges.join(gone, ["src", "tgt"], "left_anti").unionByName(inserted), "edges")
    seeds = seeds.select("ep", "node").distinct()
    hit = before.join(gone, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node")).distinct()
    # what was behind a deleted edge, over the edges of before
    doubt = cut(reach(edges, hit, table=True).select("ep", "node"), "doubt")
    sure = before.join(doubt, ["ep", "node"], "left_anti")
    into = cut(now.join(doubt.select(F.col("node").alias("tgt")).distinct(), "tgt", "left_semi"), "into")
    held = sure.join(into, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node")).unionByName(seeds).distinct().join(doubt, ["ep", "node"], "left_semi")
    safe = cut(held, "safe")
    frontier, level = safe, 0
    while not frontier.isEmpty():
        step = frontier.join(into, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node")).distinct()
        frontier = cut(step.join(doubt, ["ep", "node"], "left_semi").join(safe, ["ep", "node"], "left_anti"), "safe")
        safe, level = safe.unionByName(frontier), level + 1
        safe = cut(safe, "safe") if level % REACH_CUT == 0 else safe
    lost = cut(doubt.join(safe, ["ep", "node"], "left_anti"), "lost")
    left = cut(before.join(lost, ["ep", "node"], "left_anti"), "left")
    starts = left.join(inserted, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node")).unionByName(seeds).distinct()
    frontier = cut(starts.join(left, ["ep", "node"], "left_anti"), "grown")
    grown, level = frontier, 0
    while not frontier.isEmpty():
        step = frontier.join(now, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node")).distinct()
        # the frontier meets the old closure by its own few nodes
        step = cut(step.join(grown, ["ep", "node"], "left_anti"), "grown")
        known = left.join(step, ["ep", "node"], "left_semi")
        frontier = cut(step.join(known, ["ep", "node"], "left_anti"), "grown")
        grown, level = grown.unionByName(frontier), level + 1
        grown = cut(grown, "grown") if level % REACH_CUT == 0 else grown
    return left.unionByName(grown)
