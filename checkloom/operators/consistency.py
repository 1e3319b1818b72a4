"""Consistency analytics: baskets of checks, closed frequent itemsets, leave-one-out rules, their filters, diffs.

baskets: (ep, items array<string>), items distinct and sorted. The basket of an entry point is left out of its own
rules' counts, which gives closed forms over plain supports (no pass over the transactions for each rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from checkloom.operators import closed
from checkloom.operators.order import placed
from checkloom.plans.shared import cut

MIN_SUPPORT, MIN_SIZE, MIN_CONFIDENCE = 2, 2, 0.85
MAX_GROWTH, EMPTY_SHARE = 5.0, 0.5


def baskets(facts: DataFrame, ep: str, item: str) -> DataFrame:
    return facts.groupBy(F.col(ep).alias("ep")).agg(F.sort_array(F.collect_set(item)).alias("items"))


def vocabulary(checks: DataFrame) -> DataFrame:
    """Distinct checks (op1, op2) but pairs of equal operands."""
    return checks.where(F.col("op2").isNull() | (F.col("op1") != F.col("op2"))).select("op1", "op2").distinct()


def collapse(rows: DataFrame) -> DataFrame:
    """(class_id, items, eps): items with one and the same set of entry points; class_id is the least of them."""
    tids = rows.select("ep", "item").distinct().groupBy("item").agg(F.sort_array(F.collect_list("ep")).alias("eps"))
    return tids.groupBy("eps").agg(F.sort_array(F.collect_list("item")).alias("items")).select(F.col("items")[0].alias("class_id"), "items", "eps")


def closed_itemsets(rows: DataFrame, min_support: int = MIN_SUPPORT, min_size: int = 1, group: str | None = None) -> DataFrame:
    """([group,] items, support): itemsets of `min_size` classes or more that `min_support` baskets hold and no larger set
    of equal support has. Items that always occur together are one class; all of a class's items are given."""
    out = closed.closed_itemsets(rows, min_support, min_size, group)
    return out.select(*([F.col("grp").alias(group)] if group else []), "items", "support")


def rules(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_size: int = MIN_SIZE, group: str | None = None) -> DataFrame:
    """([group,] items, lhs, rhs, support, confidence, lift, conviction, dconf, jaccard): leave-one-out rules of each distinct
    basket that no other entry point's basket contains, or that has one item (class of items). With `group`, each value of
    that column is an input of its own."""
    out = closed.rules(rows, min_confidence, min_size, group, MIN_SUPPORT)
    return out.withColumnRenamed("grp", group) if group else out.drop("grp")


def classify_rhs(found: DataFrame, simple: DataFrame, group: str | None = None) -> DataFrame:
    """Rules with rhs split into `missing` and `alt` (same simplified form in the basket), and jaccard of the whole sets.
    simple: item, simplified; an item without a row is its own form. Rules whose missing forms are MAX_GROWTH times the
    lhs or more go. A rule is told by its sets themselves."""
    key = [*([group] if group else []), "items", "lhs", "rhs"]
    form = lambda c: found.select(*key, F.explode(c).alias("item")).join(simple, "item", "left").select(*key, "item", F.coalesce("simplified", "item").alias("simplified"))
    t = form("items").groupBy(*key).agg(F.collect_set("simplified").alias("have"))
    m = form("rhs").join(t, key)
    alt = F.array_contains("have", F.col("simplified"))
    s = m.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.when(~alt, F.col("item")))).alias("missing"), F.sort_array(F.collect_set(F.when(alt, F.col("item")))).alias("alt"),
        F.countDistinct(F.when(~alt, F.col("simplified"))).alias("forms"),
    )
    out = found.join(s, key).where((F.col("forms") / F.size("lhs")) < MAX_GROWTH).drop("forms")
    return out.withColumn("jaccard", F.size("lhs") / F.size("items"))


RANK = ("jaccard", "confidence", "support", "lhs", "rhs", "dconf", "lift")


def without_redundant(found: DataFrame, by: str | tuple[str, ...] = "items") -> DataFrame:
    """Drops a rule whose rhs is within the rhs of an earlier rule of its basket, ranked by RANK descending. Subset is
    transitive, so the greedy pass equals a test against all earlier rules; candidates meet on one shared item."""
    by = [by] if isinstance(by, str) else list(by)
    w = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in RANK])
    r = cut(found.withColumn("rank", F.row_number().over(w)), "ranked")
    one = r.select(*by, "rank", "rhs", F.col("rhs")[0].alias("item"))
    two = r.select(*by, F.col("rank").alias("before"), F.col("rhs").alias("wide"), F.explode("rhs").alias("item"))
    out = one.join(two, [*by, "item"]).where((F.col("before") < F.col("rank")) & (F.size(F.array_except("rhs", "wide")) == 0)).select(*by, "rank").distinct()
    return r.join(out, [*by, "rank"], "left_anti")


def missing_antecedent(found: DataFrame) -> DataFrame:
    return found.withColumn("unmatched", F.array_except("items", "lhs"))


def unmatched_by_form(found: DataFrame, simple: DataFrame) -> DataFrame:
    """(items, lhs, rhs, simplified, unmatched): the basket's items outside the antecedent, grouped by simplified form."""
    key = ["items", "lhs", "rhs"]
    each = missing_antecedent(found).select(*key, F.explode("unmatched").alias("item")).join(simple, "item", "left")
    return each.groupBy(*key, F.coalesce("simplified", "item").alias("simplified")).agg(F.sort_array(F.collect_set("item")).alias("unmatched"))


def ranked_itemsets(sets: DataFrame) -> DataFrame:
    """Itemsets in order, with their place, by support, then items, both falling."""
    return placed(sets, F.col("support").desc(), F.col("items").desc()).orderBy("place")


def other_eps(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(items, lhs, rhs, eps): entry points whose baskets hold lhs and rhs. A whole meets the baskets that hold its first
    and last item, an equi-join on a pair, and is then compared item by item."""
    r = found.select("items", "lhs", "rhs", F.sort_array(F.concat("lhs", "rhs")).alias("whole")).distinct()
    wanted = r.select("whole", F.col("whole")[0].alias("p"), F.element_at("whole", -1).alias("q")).distinct()
    both = F.flatten(F.transform("items", lambda p: F.transform(F.filter("items", lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    # equal baskets are compared once; what holds a whole then meets its entry points
    each = rows.select("items").distinct().select("items", F.explode(both).alias("pq")).select(F.col("items").alias("basket"), "pq.p", "pq.q")
    match = cut(wanted.join(each, ["p", "q"]).where(F.size(F.array_except("whole", "basket")) == 0).select("whole", "basket"), "wholes")
    eps = match.join(rows.select("ep", F.col("items").alias("basket")), "basket").groupBy("whole").agg(F.sort_array(F.collect_list("ep")).alias("eps"))
    return r.join(eps, "whole").select("items", "lhs", "rhs", "eps")


def empty_target_itemsets(rows: DataFrame, share: float = EMPTY_SHARE) -> DataFrame:
    """(items, support, share): what an entry point without checks is told: closed sets of half of the group or more."""
    n = rows.count()
    return closed_itemsets(rows).select("items", "support", (F.col("support") / n).alias("share")).where(F.col("share") >= share)


def set_diff(a: Column, b: Column) -> Column:
    """struct(plus, minus, same) of two sets."""
    return F.struct(F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"), F.array_intersect(a, b).alias("same"))


def vendor_diff(vendor: DataFrame, base: DataFrame) -> DataFrame:
    """(ep, antecedent, rule_id, base_id, plus, minus, same): vendor rules against baseline rules of the same entry point
    and antecedent set; a vendor rule with an equal baseline rule has no diff. Columns: ep, rule_id, antecedent, consequent."""
    key = lambda df, p: df.select("ep", F.sort_array("antecedent").alias("antecedent"), F.col("rule_id").alias(f"{p}rule_id"), F.sort_array("consequent").alias(f"{p}c"))
    v, b = key(vendor, "v_"), key(base, "b_")
    both = v.join(b, ["ep", "antecedent"])
    equal = both.where(F.col("v_c") == F.col("b_c")).select("ep", "v_rule_id").distinct()
    return both.join(equal, ["ep", "v_rule_id"], "left_anti").select("ep", "antecedent", F.col("v_rule_id").alias("rule_id"), F.col("b_rule_id").alias("base_id"), set_diff(F.col("v_c"), F.col("b_c")).alias("d")).select("ep", "antecedent", "rule_id", "base_id", "d.plus", "d.minus", "d.same")


def jaccard(a: Column, b: Column) -> Column:
    """0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
