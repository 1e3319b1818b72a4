import itertools
import os
import random
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checkloom.functions import phrases
from checkloom.operators import cfg, closed, consistency, graph, joins, lookup, order, pairs, restrictions, rule_lists
from checkloom.operators import values as mining
from checkloom.plans.stages import Registry, Stage
from checkloom.sources import check_text, reports
from checkloom.streaming import manifest


def rows(df):
    return Counter(map(tuple, df.collect()))


def brute_rules(data):
    """Leave-one-out rules of every basket by passes over the transactions."""
    sets = [frozenset(b) for _, b in data]
    n, items = len(sets), sorted(set().union(*sets))
    freq = {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            s = sum(set(c) <= t for t in sets)
            if s >= 2:
                freq[frozenset(c)] = s
    closed = [c for c, s in freq.items() if len(c) >= 2 and not any(c < e and s == freq[e] for e in freq)]
    out = set()
    for t in set(sets):
        if t in closed:
            continue
        rest = list(sets)
        rest.remove(t)
        for c in closed:
            lhs, rhs = t & c, c - t
            if not rhs or not lhs:
                continue
            conf = sum(c <= x for x in rest) / sum(lhs <= x for x in rest)
            if conf >= 0.85:
                share = sum(rhs <= x for x in rest) / (n - 1)
                sd = t - lhs
                d = sum(t <= x for x in rest) / sum(lhs <= x for x in rest) if sd else -1.0
                f = lambda s: ",".join(sorted(s))
                out.add((f(t), f(lhs), f(rhs), freq[c], round(conf, 9), round(conf / share, 9), round((1 - share) / (1 - conf), 9) if conf != 1 else 1.0, round(d, 9), round(len(lhs) / len(t), 9)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rules(spark, seed):
    rng = random.Random(seed)
    data = [(i, sorted(rng.sample("abcdef", rng.randint(1, 5)))) for i in range(9)]
    df = spark.createDataFrame(data, "ep long, items array<string>")
    r = consistency.rules(df)
    got = {(",".join(x["items"]), ",".join(sorted(x.lhs)), ",".join(sorted(x.rhs)), x.support, *(round(x[c], 9) for c in ("confidence", "lift", "conviction", "dconf", "jaccard"))) for x in r.collect()}
    assert got == brute_rules(data)


def test_rules_by_group_of_collapsed_items(spark):
    """Each group is mined on its own; items that always occur together are one class and come back as items."""
    rng = random.Random(8)
    data, wanted = [], set()
    for g in ("x", "y"):
        own = [(f"{g}{i}", sorted(rng.sample("abcd", rng.randint(1, 3)))) for i in range(9)]
        wanted |= {(g, *r) for r in brute_rules(own)}
        # z always comes with a: one class of two items
        data += [(g, ep, [*items, "z"] if "a" in items else items) for ep, items in own]
    df = spark.createDataFrame(data, "file string, ep string, items array<string>")
    found = consistency.rules(df, group="file").collect()
    plain = lambda x: ",".join(sorted(set(x) - {"z"}))
    assert {(r.file, plain(r["items"]), plain(r.lhs), plain(r.rhs), r.support, *(round(r[c], 9) for c in ("confidence", "lift", "conviction", "dconf", "jaccard"))) for r in found} == wanted
    assert all(("a" in s) == ("z" in s) for r in found for s in (r["items"], r.lhs, r.rhs))
    simple = spark.createDataFrame([("a", "A"), ("z", "A")], "item string, simplified string")
    kept = consistency.classify_rhs(consistency.rules(df, group="file"), simple, "file").collect()
    assert all(abs(r.jaccard - len(r.lhs) / len(r["items"])) < 1e-9 for r in kept) and all(sorted([*r.missing, *r.alt]) == sorted(r.rhs) for r in kept)
    sets = consistency.ranked_itemsets(consistency.closed_itemsets(df, group="file")).collect()
    assert [(-r.support) for r in sets] == sorted(-r.support for r in sets)


def test_closed_sets_of_wide_baskets(spark):
    """Sixty to eighty items a basket: closed sets are the intersections of baskets that two or more hold."""
    rng = random.Random(2)
    base = [set(rng.sample(range(90), 70)) for _ in range(5)]
    data = [(i, sorted(str(x) for x in base[i % 5] - set(rng.sample(range(90), 3)))) for i in range(7)]
    got = {(frozenset(r["items"]), r.support) for r in consistency.closed_itemsets(spark.createDataFrame(data, "ep long, items array<string>")).collect()}
    sets = [frozenset(x) for _, x in data]
    closed = set()
    for n in range(2, len(sets) + 1):
        for c in itertools.combinations(sets, n):
            both = frozenset.intersection(*c)
            if both:
                closed.add((both, sum(both <= t for t in sets)))
    assert got == closed and max(len(x) for x, _ in data and [(s, 0) for s in sets]) > 60


def test_strong_components_of_one_graph(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)]
    g = {i: set() for i in range(41)}
    for a, b in edges:
        g[a].add(b)
    want = {(n, max(p)) for p in cfg.strong_components(g) for n in p if len(p) > 1 or n in g[n]}
    assert set(map(tuple, graph.strong_components(spark.createDataFrame(edges, "src long, tgt long")).collect())) == want
    assert graph.strong_components(spark.createDataFrame([(1, 2), (2, 3)], "src long, tgt long")).isEmpty()


def test_depth_buckets(spark):
    """The k-th of four buckets ends at floor(10 k / 4); shallow graphs have fewer."""
    d = spark.range(11).select(F.col("id").alias("d"))
    assert [r[0] for r in d.orderBy("d").select(graph.depth_bucket(F.col("d"), F.lit(10))).collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4]
    assert [r[0] for r in d.where("d <= 2").orderBy("d").select(graph.depth_bucket(F.col("d"), F.lit(2))).collect()] == [1, 1, 1]
    x = spark.createDataFrame([(1,), (5,), (10,)], "d long").agg(graph.skewed_average(F.col("d"), F.col("d"), F.lit(10))).first()[0]
    assert x == int((1 / 1 + 5 / 2 + 10 / 4) / (1 + 1 / 2 + 1 / 4) + 0.5)


def test_long_chain_has_all_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(56)], "src long, tgt long")
    assert graph.first_paths(e, spark.createDataFrame([(0, 0)], "ep long, node long")).count() == 57


def test_redundancy_equals_greedy(spark):
    rng = random.Random(5)
    data = [("k", "k", ["l"], sorted(rng.sample("abcde", rng.randint(1, 4))), i, 0.9, 0.5, 0.0, 1.0) for i in range(12)]
    df = spark.createDataFrame(data, "items string, x string, lhs array<string>, rhs array<string>, support long, confidence double, jaccard double, dconf double, lift double")
    kept = []
    for r in sorted(data, key=lambda r: -r[4]):
        if not any(set(r[3]) <= set(k[3]) for k in kept):
            kept.append(r)
    assert {r.support for r in consistency.without_redundant(df).collect()} == {k[4] for k in kept}


def test_collapse_and_diff(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "ep long, item string")
    assert rows(consistency.collapse(df).select("class_id", F.array_join("items", ""))) == Counter([("a", "ab"), ("c", "c")])
    rule = "ep string, rule_id string, antecedent array<string>, consequent array<string>"
    vendor = spark.createDataFrame([("e", "v1", ["a", "b"], ["x"]), ("e", "v2", ["c"], ["y", "z"]), ("only", "v3", ["a"], ["b"])], rule)
    base = spark.createDataFrame([("e", "b1", ["b", "a"], ["x"]), ("e", "b0", ["a", "b"], ["q"]), ("e", "b2", ["c"], ["z", "w"])], rule)
    got = consistency.vendor_diff(vendor, base).collect()
    assert [(r.rule_id, r.base_id, r.plus, r.minus, r.same) for r in got] == [("v2", "b2", ["y"], ["w"], ["z"])]


SHAPES = [(1, 2), (2, 3), (3, 1), (3, 3), (2, 4), (4, 5), (1, 5), (5, 6), (7, 8), (8, 7)]


def test_reach(spark):
    e = spark.createDataFrame(SHAPES, "src long, tgt long")
    seeds = spark.createDataFrame([(1, 1), (7, 7)], "ep long, node long")
    assert rows(graph.reach(e, seeds)) == Counter([(1, 1, 0), (1, 2, 1), (1, 5, 1), (1, 3, 2), (1, 4, 2), (1, 6, 2), (7, 7, 0), (7, 8, 1)])
    x = spark.createDataFrame([(5,), (3,)], "node long")
    leaf, drop = graph.reach(e, seeds, x), graph.reach(e, seeds, x, "drop")
    assert {r.node for r in leaf.collect() if r.ep == 1} == {1, 2, 3, 4, 5} and {r.node for r in drop.collect() if r.ep == 1} == {1, 2, 4}
    own = spark.createDataFrame([(7, 7)], "ep long, node long")
    assert {r.node for r in graph.reach(e, seeds, own).collect() if r.ep == 7} == {7}
    assert graph.reach(e, seeds, max_level=1).where("level > 1").isEmpty()
    allowed = graph.allowed_edges(e, graph.reach(e, seeds))
    assert {r.node for r in graph.on_paths(allowed, spark.createDataFrame([(4,)], "sink long")).collect()} == {1, 2, 3, 4}
    depth = rows(graph.depth_sets(e, graph.reach(e, seeds)))
    assert depth[1, 5, 1] and depth[1, 5, 3] and depth[1, 1, 3]
    paths = {r.node: r.path for r in graph.first_paths(e, seeds).collect() if r.ep == 1}
    assert paths[6] == [1, 5, 6] and paths[3] == [1, 2, 3]
    assert rows(graph.subgraph_sizes(e, graph.reach(e, seeds)))[1, 6, 7] == 1


def test_expansion_and_values(spark):
    defs = spark.createDataFrame([("t", 0, "a"), ("t", 0, "b"), ("t", 1, "c"), ("a", 0, "x"), ("a", 0, "y"), ("loop", 0, "loop"), ("up", 0, "loop"), ("n", 0, None)], "use string, operand int, def string")
    n = dict(map(tuple, mining.expansion_count(defs.where("def is not null and use not in ('loop', 'up')"), spark.createDataFrame([("t",)], "node string")).select("node", "n").collect()))
    assert n["t"] == 3 and n["a"] == 2 and n["x"] == 1
    nodes = spark.createDataFrame([("t", "{0}+{1}", True), ("a", "f({0})", True), ("b", "B", True), ("c", "C", False), ("x", "X", True), ("y", "Y", True), ("loop", "g({0})", True), ("up", "h({0})", True), ("n", "k({0})", True)], "node string, pattern string, allowed boolean")
    v = {r.node: sorted(r["values"]) for r in mining.resolve(nodes, defs).collect()}
    assert v["t"] == ["B+ALL", "f(X)+ALL", "f(Y)+ALL"] and v["loop"] == ["ALL"] and v["up"] == ["h(ALL)"] and v["n"] == ["k(NONE)"]
    assert {r.node: r["values"] for r in mining.resolve(nodes, defs, limit=1).collect()}["t"] == ["ALL"]


def test_values_of_missing_nodes_cycles_and_braces(spark):
    """A definition without a node ends in ALL (it never ended before), values that spell placeholders are not filled again, a
    root's values are made alone, and the sets' simplification is that of arrays."""
    nodes = spark.createDataFrame([("t", "{0}|{1}", True), ("v", "{1}", True), ("w", "Z", True), ("m", "f({0})", True), ("a", "a{0}", True), ("b", "b{0}", True), ("p", "{0}", True), ("n7", "7", True), ("d", "D", False), ("q", "{0}", True), ("nul", "NULL", True)], "node string, pattern string, allowed boolean")
    defs = spark.createDataFrame([("t", 0, "v"), ("t", 1, "w"), ("m", 0, "gone"), ("a", 0, "b"), ("b", 0, "a"), ("b", 1, "w"), ("p", 0, "n7"), ("p", 0, "d"), ("q", 0, "nul"), ("q", 0, "w"), ("q", 0, "a")], "use string, operand int, def string")
    want = {"t": ["{1}|Z"], "v": ["{1}"], "w": ["Z"], "m": ["f(ALL)"], "a": ["ALL"], "b": ["ALL"], "p": ["ALL"], "n7": ["7"], "d": ["ALL"], "q": ["ALL", "Z"], "nul": ["NULL"], "gone": ["ALL"]}
    assert {r.node: r["values"] for r in mining.resolve(nodes, defs).collect()} == want
    only = mining.expand(mining.factored(nodes, defs), spark.createDataFrame([("q",), ("m",)], "node string"))
    assert rows(only) == Counter([("q", "ALL"), ("q", "Z"), ("m", "f(ALL)")])


def test_expansion_counts_beyond_decimals_and_on_cycles(spark):
    """Seven levels of cubes of ten: 10^1093 at the top, exact up to 38 digits; cycles and what leads to them are endless."""
    arcs = [(f"l{i}", k, f"l{i + 1}x{j}") for i in range(7) for k in range(3) for j in range(10)] + [(f"l{i + 1}x{j}", 0, f"l{i + 1}") for i in range(6) for j in range(10)]
    arcs += [("c1", 0, "c2"), ("c2", 0, "c1"), ("over", 0, "c1"), ("over", 1, "leaf"), ("self", 0, "self")]
    got = {r.node: r for r in mining.expansion_count(spark.createDataFrame(arcs, "use string, operand int, def string"), spark.createDataFrame([("alone",)], "node string")).collect()}
    digits, want = 0, {}
    for i in range(6, -1, -1):
        digits = 3 * (digits + 1)
        want[f"l{i}"] = digits
    for node, d in want.items():
        assert got[node].n == (10**d if d < 38 else None) and abs(got[node].log10 - d) < 1e-6 and not got[node].endless
    assert (got["alone"].n, got["leaf"].n) == (1, 1)
    assert all(got[x].endless and got[x].n is None and got[x].log10 == float("inf") for x in ("c1", "c2", "over", "self"))
    assert len(got) == len({x for a in arcs for x in (a[0], a[2])}) + 1


def brute_dominators(g, root):
    reach = lambda skip: set(cfg.post_order({k: {t for t in v if t != skip} for k, v in g.items()}, root)) if skip != root else set()
    full = set(cfg.post_order(g, root))
    return {n: {d for d in full if d == n or n not in reach(d)} for n in full}


def test_control_flow():
    rng = random.Random(3)
    for _ in range(60):
        g = {i: {rng.randint(0, 7) for _ in range(rng.randint(0, 2))} for i in range(8)}
        idom = cfg.immediate_dominators(g, 0)
        assert {n: set(cfg.dominators_of(idom, n)) for n in idom} == brute_dominators(g, 0)
        parts = cfg.strong_components(g)
        same = lambda a, b: b in cfg.post_order(g, a) and a in cfg.post_order(g, b)
        assert sorted(sum(parts, [])) == list(range(8)) and all(same(p[0], x) for p in parts for x in p)
        assert len({min(x for x in g if same(x, n)) for n in g}) == len(parts)
        for c in cfg.simple_cycles(g):
            assert c[0] == min(c) and all(b in g[a] for a, b in zip(c, c[1:] + c[:1], strict=True))
    g = {0: {1}, 1: {2, 5}, 2: {3, 4}, 3: {1}, 4: {1}, 5: set()}
    assert cfg.control_dependence(g) == {(1, 1), (2, 1), (3, 2), (4, 2)} and (3, 1) in cfg.iterated(cfg.control_dependence(g))
    assert cfg.natural_loops(g, 0) == [(1, [1, 2, 3, 4], [1], True)] and cfg.simple_cycles(g) == [[1, 2, 3], [1, 2, 4]]


def test_rule_lists(spark):
    lines = ["// head", "+ ClassPath a.*", "- SuperClass [overrides] a.Base", "+ Interface a.I // why", "- MethodName clear", "", "- MethodSpecial IncludeSubClasses=true ClassName=a.Base Method=(equal-name run)", "+ ClassPath [mprivate] a.b.C"]
    r = rule_lists.parse_rules(spark.createDataFrame(list(enumerate(lines)), "idx int, value string"))
    m = [("<a.Base: void run()>", "a.Base", "run", "run()", 1, 1), ("<a.Sub: void run()>", "a.Sub", "run", "run()", 1, 1), ("<a.Sub: void own()>", "a.Sub", "own", "own()", 1, 1), ("<a.b.C: void clear()>", "a.b.C", "clear", "clear()", 1, 1), ("<a.b.C: void p()>", "a.b.C", "p", "p()", 2, 1), ("<z.Z: void q()>", "z.Z", "q", "q()", 1, 1)]
    methods = spark.createDataFrame(m, "sig string, class string, name string, subsig string, modifiers int, class_modifiers int")
    up = spark.createDataFrame([("a.Sub", "a.Base", "class")], "sub string, super string, kind string")
    got = dict(map(tuple, rule_lists.decide(methods, r, ancestors=up).collect()))
    assert got == {"<a.Base: void run()>": False, "<a.Sub: void run()>": False, "<a.Sub: void own()>": True, "<a.b.C: void clear()>": False, "<a.b.C: void p()>": True, "<z.Z: void q()>": False}
    with pytest.raises(Exception, match="malformed"):
        rule_lists.parse_rules(spark.createDataFrame([(0, "+ Nope x")], "idx int, value string")).collect()


def test_joins(spark):
    checks = spark.createDataFrame([("e", "$0", "x", None, False), ("c", "call e", None, "e", True), ("d", "call e", None, "e", False)], "ep string, op1 string, op2 string, called string, root boolean")
    args = spark.createDataFrame([("c", "e", ["7"]), ("d", "e", ["8"])], "ep string, called string, values array<string>")
    assert rows(joins.substitute_entry_points(checks, args)) == Counter([("e", "$0", "x"), ("c", "7", "x"), ("d", "call e", None), ("d", "8", "x")])
    ops = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "z")], "expr long, pos int, value string")
    assert rows(joins.substitution_product(ops)) == Counter([(1, "a, c"), (1, "b, c"), (2, "z")]) and rows(joins.substitution_product(ops, 1))[1, "ALL"] == 1
    c = spark.createDataFrame([("e", "a", None, "s1", 1), ("e", "a", None, "s2", 1), ("e", "b", None, "s3", 1)], "ep string, op1 string, op2 string, source string, stmt int")
    left = joins.restrict_sources(c, spark.createDataFrame([("s1", 1)], "source string, stmt int"))
    assert {(r.op1, r.source) for r in left.collect()} == {("a", "s1"), ("b", "s3")}
    p = spark.createDataFrame([(1, "v", ["s"], ["e", "f"]), (2, "w", ["s"], ["e"])], "pair int, value string, sources array<string>, eps array<string>")
    r = spark.createDataFrame([(1, "v", ["s"], ["e", "*"]), (2, "*", ["s"], ["e"])], "rule int, value string, sources array<string>, eps array<string>")
    assert rows(joins.wildcard_rules(p, r)) == Counter([(1, 1), (2, 2)])


def test_restrictions(spark):
    nodes = spark.createDataFrame([("e", 1, "invoke", "+", "m", None), ("e", 2, "invoke", None, "k", None), ("e", 3, "const", None, None, 4), ("e", 10, "start", "==", None, None), ("e", 11, "start", "call", None, None)], "ep string, node long, kind string, expr_op string, target string, const long")
    edges = spark.createDataFrame([("e", 10, 1), ("e", 1, 3), ("e", 11, 2), ("e", 2, 3)], "ep string, use long, def long")
    starts = spark.createDataFrame([("e", 10), ("e", 11)], "ep string, start long")
    ids = lambda df: {r.start for r in df.collect()}
    assert ids(restrictions.keep_method_return_use(starts, nodes, edges, F.col("target") == "m")) == {10}
    assert ids(restrictions.keep_number_use(starts, nodes, edges, F.col("const") == 4)) == {10, 11}
    chain = restrictions.in_arithmetic_chain(nodes, edges)
    assert ids(restrictions.keep_number_use(starts, nodes, edges, F.col("const") == 4, chain)) == {10}
    both = restrictions.union_of(chain, restrictions.in_arithmetic_op(nodes, edges, "=="))
    assert ids(restrictions.keep_method_return_use(starts, nodes, edges, F.lit(True), both)) == {10, 11}  # 11 uses 2 directly, in its root
    queries = spark.createDataFrame([("k",)], "target string")
    assert ids(restrictions.keep_context_query_use(starts, nodes, edges, queries)) == {11}


def test_check_text_and_pairs(spark):
    lines = spark.createDataFrame([("s", "`none`"), ("s", "`e`; `a`; {`b`, `A`}"), ("s", "`e2`; {`x`, `x`}"), ("t", "")], "stub string, value string")
    checks = check_text.parse_checks(lines)
    assert rows(checks) == Counter([("s", "none", None, None, None), ("s", "e", 1, "a", None), ("s", "e", 2, "A", "b"), ("s", "e2", 1, "x", "x")])
    assert rows(check_text.check_lines(checks)) == Counter([("s", "`none`"), ("s", "`e`; `a`; {`A`, `b`}"), ("s", "`e2`; {`x`, `x`}")])
    assert {r.ep: r["items"] for r in check_text.features(checks).collect()} == {"none": [], "e": ["`a`", "{`A`, `b`}"], "e2": []}
    with pytest.raises(Exception, match="malformed"):
        check_text.parse_checks(spark.createDataFrame([("s", "`e`; oops")], "stub string, value string")).collect()
    raw = spark.createDataFrame([("<java.lang.String: boolean equals(java.lang.Object)>(p, q)", "1"), ("1", "2"), ("v", "NULL"), ("B", "a"), ("a", "B")], "op1 string, op2 string")
    assert rows(pairs.simplify(raw)) == Counter([("p", "q"), ("a", "B")])


def test_reports_and_manifest(spark, tmp_path):
    r = spark.createDataFrame([("e", "1", ["a", "b<"], ["c"], [], ["d"], ["x"], 3, 0.9, 0.5, 1.0, 2.0)], "ep string, rule_id string, antecedent array<string>, consequent array<string>, alternative array<string>, missing array<string>, entrypoints array<string>, support long, confidence double, jaccard double, lift double, conviction double")
    reports.write_rules_xml(r, str(tmp_path / "xml"))
    back = reports.read_rules_xml(spark, str(tmp_path / "xml"))
    assert back.first().asDict() == r.first().asDict()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.txt").write_text("`e`; `a`\n")
    assert {(x.stub, x.ep, x.op1) for x in check_text.read_checks(spark, str(tmp_path / "in")).collect()} == {("s", "e", "a")}
    q = manifest.stream_checks(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("checks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select stub, op1 from checks").collect() == [("s", "a")]
    old = [tuple(x) for x in manifest.file_manifest(spark, str(tmp_path / "in")).collect()]
    before = spark.createDataFrame(old, "path string, hash string")
    assert not manifest.needed(before, manifest.file_manifest(spark, str(tmp_path / "in")))
    (tmp_path / "in" / "t.txt").write_text("`f`\n")
    assert [x.change for x in manifest.changes(before, manifest.file_manifest(spark, str(tmp_path / "in"))).collect()] == ["added"]
    g = spark.createDataFrame([("f", 0, "group one"), ("f", 1, "a"), ("f", 2, "// no"), ("f", 3, "group"), ("f", 4, "b")], "file string, idx int, value string")
    assert rows(reports.group_list(g).select("group", "name")) == Counter([(1, "a"), (2, "b")])
    assert rows(lookup.edge_types(spark.createDataFrame([("a", "b", "internal"), ("a", "b", "external"), ("a", "c", "internal")], "ep string, ref_ep string, type string"))) == Counter([("a", "b", "both"), ("a", "c", "internal")])


def test_stages(spark, tmp_path):
    reg = Registry()
    reg.add(Stage("one", lambda s, _: s.range(3)))
    reg.add(Stage("two", lambda s, x: x["one"].where("id > 0"), ("one",)))
    assert reg.order("two") == ["one", "two"]
    assert reg.run(spark, str(tmp_path), "two")["two"].count() == 2
    with pytest.raises(ValueError):
        reg.add(Stage("one", lambda s, _: s.range(1)))


def test_entry_has_a_flagship_and_sql_of_known_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).collect()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_catalogue_without_llm(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline has all other queries, and none of theirs."""
    import __spark_entry__ as e

    home = Path(e.__file__).parent
    shutil.copytree(home / "checkloom", tmp_path / "checkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.splitlines()
    names, sql = (set(line.split()) for line in out)
    own = lambda x: {n for n in x if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert names == own(e.queries()) and sql == own(e.oracle_sql()) and len(names) > 150
    assert not (tmp_path / "checkloom" / "llm").exists()


def test_query_command(spark, tmp_path, capsys):
    """The look-ups of the command line: all checks, some entry points, one check, statistics; two keyed folders."""
    import base64

    from checkloom import query

    one = spark.createDataFrame([("s1", "<a.B: void f()>", "a", "b"), ("s1", "<a.B: void g()>", "c", None), ("s1", "<a.B: void h()>", None, None)], "stub string, ep string, op1 string, op2 string")
    two = one.where("op2 is not null").withColumn("stub", F.lit("s2"))
    check_text.write_checks(one, str(tmp_path / "one"))
    check_text.write_checks(two, str(tmp_path / "two"))
    checks = query.load(spark, [f"K1;{tmp_path / 'one'}", f"K2;{tmp_path / 'two'}"])
    assert {r.key for r in checks.select("key").distinct().collect()} == {"K1", "K2"} and checks.count() == 4
    got = query.answer(checks.withColumn("stub", F.lit("s"))).collect()
    assert [(r.ep, r.check, r["keys"]) for r in got] == [("<a.B: void f()>", "{`a`, `b`}", "K1|K2"), ("<a.B: void g()>", "`c`", "K1")]
    assert query.answer(checks, ["<a.B: void g()>"]).count() == 1 and query.answer(checks, None, "`c`").count() == 1
    query.main(["-d", str(tmp_path / "one"), "-p", base64.urlsafe_b64encode(b"`c`").decode()])
    shown = capsys.readouterr().out
    assert "void g()" in shown and "void f()" not in shown
    query.main(["-d", str(tmp_path / "one"), "--stats"])
    assert capsys.readouterr().out.strip()


def test_substitution_product_takes_every_operand_and_value(spark):
    from checkloom.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    ops: dict = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey").collect():
        ops.setdefault(r.l_orderkey, {}).setdefault(r.l_linenumber, set()).add(str(r.l_suppkey))
    want = Counter((e, ", ".join(v)) for e, by in ops.items() for v in itertools.product(*(by[p] for p in sorted(by))))
    assert max(p for by in ops.values() for p in by) > 3 and len(ops) > 500
    assert rows(QUERIES["substitution_product"](spark, sf)) == want


def test_products_have_no_limit(spark):
    """47^3 = 103,823 combinations, more than the 100,000 that became ALL."""
    ops = spark.range(3 * 47).selectExpr("1L AS expr", "CAST(id % 3 AS int) AS pos", "concat('v', id div 3) AS value")
    got = joins.substitution_product(ops)
    assert (got.count(), got.distinct().count(), got.where("text = 'ALL'").count()) == (47**3, 47**3, 0)
    leaves = spark.range(3 * 47).selectExpr("concat('s', id) AS node", "concat('s', id) AS pattern", "true AS allowed")
    tops = spark.createDataFrame([("o", "f({0}, {1}, {2})", True)], "node string, pattern string, allowed boolean")
    defs = spark.range(3 * 47).selectExpr("'o' AS use", "CAST(id % 3 AS int) AS operand", "concat('s', id) AS def")
    assert mining.resolve(leaves.union(tops), defs).where("node = 'o'").select(F.size("values")).first()[0] == 47**3


def test_phrase_rules_against_regular_expressions(spark):
    """Random phrases by random patterns: one walk says what a regular expression for each pattern says, also with more patterns
    than one mask has bits and with automata that must be split."""
    rng = random.Random(8)
    words = ["get", "has", "user", "id", "is", "x", "a", "b"]
    pieces = [("{w}", "{w}"), ("({w}|{v} {w})", "(?:{w}|{v} {w})"), ("{w}?", "(?:{w} )?"), ("*", r"(?:\\S+ )*")]

    def pattern():
        ours, theirs = [], []
        for _ in range(rng.randint(1, 4)):
            a, b = rng.choice(pieces)
            w, v = rng.choice(words), rng.choice(words)
            ours.append(a.format(w=w, v=v))
            theirs.append(b.replace("\\\\", "\\").format(w=w, v=v) + ("" if a in ("{w}?", "*") else " "))
        start, end = rng.random() < 0.4, rng.random() < 0.4
        return ("^" if start else "") + " ".join(ours) + ("$" if end else ""), ("^ " if start else " ") + "".join(theirs) + ("$" if end else "")

    every = dict(pattern() for _ in range(90))
    phrases_ = [" ".join(rng.choice([*words, "other"]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    own = phrases.Phrases(list(every))
    df = spark.createDataFrame([(p,) for p in phrases_], "t string").withColumn("bits", own.bits(F.split("t", " ")))
    for r in df.select("t", *[own.hit(F.col("bits"), p).alias(str(i)) for i, p in enumerate(every)]).collect():
        for i, (p, rx) in enumerate(every.items()):
            assert r[str(i)] == bool(re.search(rx, f" {r.t} ")), (r.t, p, rx)
    for wrong in ("", "^", "(a", "a)", "?", "a ^b", "(a|b c"):
        with pytest.raises(phrases.PhraseError):
            phrases.compiled([wrong])


def test_phrase_rules_of_names(spark):
    rules = phrases.read_rules(["// comment", "", "first: ^get * id$ ; in com.a com.b ; not-in mock ; except com.a.K.getOwnId", "second: user ; unless ^is", "third: *"])
    names = spark.createDataFrame([("com.a.X", "getUserId"), ("com.a.mock", "getUserId"), ("com.a.K", "getOwnId"), ("org", "isUser"), (None, "get_user"), ("com.b", None), ("com.b", "getID")], "package string, name string")
    got = {(r.package, r.name): r.rule for r in phrases.classify(names, rules).collect()}
    assert got == {("com.a.X", "getUserId"): "first", ("com.a.mock", "getUserId"): "second", ("com.a.K", "getOwnId"): "third", ("org", "isUser"): "third", (None, "get_user"): "second", ("com.b", None): None, ("com.b", "getID"): "first"}
    assert phrases.classify(names, []).where("rule is not null").isEmpty()
    for wrong in ("no colon", "a:", "a: b ; what c", "a: b ; in"):
        with pytest.raises(phrases.PhraseError):
            phrases.read_rules([wrong])


def test_nested_substitution(spark):
    """Three levels, a pair in a circle, $1 beside $10, values that spell parameters, a call without arguments."""
    checks = spark.createDataFrame([
        ("leaf", "$1", "$10", None, False), ("leaf", "$0 $2", None, None, False), ("mid", "call leaf", None, "leaf", True), ("top", "call mid", None, "mid", False), ("p", "call q", None, "q", True), ("q", "call p", None, "p", True),
        ("q", "own $0", None, None, False), ("over", "call q", None, "q", True), ("bare", "call leaf", None, "leaf", True), ("lost", "call none", None, "none", True),
    ], "ep string, op1 string, op2 string, called string, root boolean")
    ten = [f"v{i}" for i in range(11)]
    args = spark.createDataFrame([("mid", "leaf", ["$1", *ten[1:]]), ("top", "mid", ["x", "y"]), ("p", "q", ["z"]), ("over", "q", ["w"]), ("over", "q", ["u"])], "ep string, called string, values array<string>")
    want = [("leaf", "$1", "$10"), ("leaf", "$0 $2", None), ("mid", "v1", "v10"), ("mid", "$1 v2", None), ("top", "call mid", None), ("top", "v1", "v10"), ("top", "y v2", None), ("p", "call q", None), ("q", "call p", None), ("q", "own $0", None), ("over", "call p", None), ("over", "own w", None), ("over", "own u", None), ("bare", "call leaf", None), ("lost", "call none", None)]
    assert rows(joins.substitute_nested(checks, args)) == Counter(want)


def test_descendant_sizes_and_ranks(spark):
    """Random graphs with cycles, over more than one word of bits, against searches."""
    rng = random.Random(3)
    edges = {(ep, rng.randrange(90), rng.randrange(90)) for ep in (0, 1) for _ in range(120)}
    got = {(r.ep, r.method): (r.n_nodes, r.n_edges) for r in order.descendant_sizes(spark.createDataFrame(list(edges), "ep long, src long, tgt long")).collect()}
    want = {}
    for ep in (0, 1):
        out: dict = {}
        for e, a, b in edges:
            if e == ep and b != ep:
                out.setdefault(a, set()).add(b)
        for m in {x for e, *ab in edges if e == ep for x in ab}:
            seen, stack = {m}, [m]
            while stack:
                for t in out.get(stack.pop(), ()):
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            want[ep, m] = (len(seen), sum(len(out.get(x, ())) for x in seen))
    assert got == want
    with pytest.raises(ValueError):
        order.ranks(spark.createDataFrame([(1, 2), (2, 1)], "src long, tgt long"), spark.createDataFrame([(1,), (2,)], "node long"))


def test_branch_blocks(spark):
    """A nested if, a case that returns (its branch never joins), an empty case, and a loop inside a case."""
    flow = [("m", 0, 1), ("m", 0, 2), ("m", 0, 9), ("m", 1, 3), ("m", 1, 4), ("m", 3, 5), ("m", 4, 5), ("m", 5, 9), ("m", 2, 6), ("m", 6, 2), ("m", 6, 9), ("m", 9, 10), ("r", 0, 1), ("r", 0, 2), ("r", 1, 3), ("r", 2, 4)]
    df = spark.createDataFrame(flow, "method string, src long, tgt long")
    assert rows(cfg.join_points(df)) == Counter([("m", 0, 9), ("m", 1, 5), ("m", 6, 9), ("r", 0, None)])
    cases = spark.createDataFrame([("m", 0, 1, 1), ("m", 0, 2, 2), ("m", 0, 3, 9), ("m", 1, 7, 3), ("r", 0, 1, 1)], "method string, branch long, tx long, stmt long")
    want = [("m", 0, 1, x) for x in (1, 3, 4, 5)] + [("m", 0, 2, x) for x in (2, 6)] + [("m", 1, 7, 3), ("r", 0, 1, 1), ("r", 0, 1, 3)]
    assert rows(cfg.branch_blocks(df, cases)) == Counter(want)


def test_mining_in_tasks_is_mining_by_levels(spark, monkeypatch):
    """Closed sets and rules do not depend on where a task takes over: every level by joins, or all below single items in
    tasks; vocabularies of two mask words, groups, repeated baskets, an empty basket, a group of one basket."""
    rng = random.Random(12)
    data = [(g, 1000 * k + i, [f"i{x:02}" for x in rng.sample(range(80), rng.randint(1, 9))] if k else [f"i{x:02}" for x in range(80) if rng.random() < 0.08]) for k, g in enumerate("ab") for i in range(60)]
    data += [("a", 7000 + i, ["i01", "i02", "i70", "i79"]) for i in range(4)] + [("a", 8000, []), ("c", 1, ["i01", "i02"])]
    df = spark.createDataFrame(data, "file string, ep long, items array<string>")

    def mined():
        sets = Counter((r.file, tuple(r["items"]), r.support) for r in consistency.closed_itemsets(df, group="file").collect())
        rules = Counter((r.file, *(tuple(r[c]) for c in ("items", "lhs", "rhs")), r.support, round(r.lift, 9), round(r.dconf, 9)) for r in consistency.rules(df, min_confidence=0.5, group="file").collect())
        return sets, rules

    in_tasks = mined()
    monkeypatch.setattr(closed, "TASK_ROWS", 0)
    assert mined() == in_tasks and len(in_tasks[0]) > 150 and len(in_tasks[1]) > 50
    for g in "ab":
        sets = [frozenset(i) for f, _, i in data if f == g]
        want, todo = set(), [s for s in set(sets) if s]
        while todo:
            s = todo.pop()
            if s and s not in want:
                want.add(s)
                todo += [s & t for t in sets]
        want = {(tuple(sorted(s)), n) for s in want if (n := sum(s <= t for t in sets)) >= 2}
        assert {(i, n) for f, i, n in in_tasks[0] if f == g} == want
