"""Locals, kept closures and inferred types against searches over random facts."""

import random
from collections import Counter

import pytest

from checkloom.operators import graph, incremental, joins, rule_lists
from checkloom.operators import locals as local_flow


def rows(df):
    return Counter(map(tuple, df.collect()))


def facts(rng, methods=8, size=9):
    """(flow, defs, uses) of random methods: locals a to d, any kinds, any arcs."""
    flow, defs, uses = [], [], []
    for m in range(methods):
        flow += [(f"m{m}", i, i + 1 if i + 1 < size else None) for i in range(size)] + [(f"m{m}", rng.randrange(size), rng.randrange(size)) for _ in range(4)]
        for i in range(size):
            if rng.random() < 0.7:
                kind = rng.choice(["value", "local", "cast", "array"])
                defs.append((f"m{m}", i, rng.choice("abcd"), kind, None if kind == "value" else rng.choice("abcd")))
            uses.append((f"m{m}", i, rng.choice("abcd")))
    return sorted(set(flow), key=str), defs, uses


def reached(flow, defs):
    """{(method, stmt, local, def)} by walking from each definition until its local is defined again."""
    out, made = set(), {(m, s): v for m, s, v, _, _ in defs}
    for m, s, v, _, _ in defs:
        stack = [s]
        first = True
        while stack:
            at = stack.pop()
            if not first and made.get((m, at)) == v:
                continue
            first = False
            for mm, a, b in flow:
                if mm == m and a == at and b is not None and (m, b, v, s) not in out:
                    out.add((m, b, v, s))
                    stack.append(b)
    return out


def through(used, defs, links, kinds):
    """Each use's definitions with those that aliases lead to."""
    kind = {(m, s): (k, src) for m, s, _, k, src in defs}
    out = set()
    for m, s, v, d in used:
        seen, stack = {d}, [d]
        while stack:
            at = stack.pop()
            k, src = kind[m, at]
            if k in kinds:
                for mm, t, local, frm in links:
                    if (mm, t, local) == (m, at, src) and frm not in seen:
                        seen.add(frm)
                        stack.append(frm)
        out |= {(m, s, v, x) for x in seen}
    return out


def test_definitions_and_uses_with_aliases(spark):
    flow, defs, uses = facts(random.Random(2))
    f = spark.createDataFrame(flow, "method string, src long, tgt long")
    d = spark.createDataFrame(defs, "method string, stmt long, local string, kind string, source string")
    u = spark.createDataFrame(uses, "method string, stmt long, local string")
    links = reached(flow, defs)
    assert rows(local_flow.reaching_definitions(f, d)) == Counter(links)
    used = {(m, s, v, x) for m, s, v, x in links if (m, s, v) in set(uses)}
    assert rows(local_flow.local_definitions(f, d, u)) == Counter(used)
    kind = {(m, s): k for m, s, _, k, _ in defs}
    for arrays, remove in ((False, ()), (False, ("local", "cast")), (True, ("array",))):
        far = through(used, defs, links, ("local", "cast", "array") if arrays else ("local", "cast"))
        want = {x for x in far if kind[x[0], x[3]] not in remove}
        assert rows(local_flow.local_definitions(f, d, u, aliases=True, arrays=arrays, remove=remove)) == Counter(want)
        want = {(m, x, s, v) for m, s, v, x in far if kind.get((m, s)) not in remove}
        assert rows(local_flow.local_uses(f, d, u, aliases=True, arrays=arrays, remove=remove)) == Counter(want)
    sets = {(r.method, r.local): r.alias_set for r in local_flow.may_aliases(d).collect()}
    for m, _, v, k, src in defs:
        assert k not in ("local", "cast") or sets[m, v] == sets[m, src] <= min(v, src)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kept_closure_is_the_full_one(spark, seed):
    """Cycles that hold themselves up after their entrance is cut, edges deleted and inserted again, seeds in doubt."""
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(1, 30), (30, 31), (31, 30)}
    gone = {e for e in edges if rng.random() < 0.15} | {(1, 30)}
    new = {(rng.randrange(45), rng.randrange(45)) for _ in range(5)} | {next(iter(gone))}
    df = lambda x: spark.createDataFrame(sorted(x), "src long, tgt long")
    seeds = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "ep long, node long")
    before = graph.reach(df(edges), seeds).select("ep", "node")
    assert rows(incremental.kept_closure(before, df(edges), df(new), df(gone), seeds)) == rows(graph.reach(df(edges - gone | new), seeds).select("ep", "node"))


def test_inferred_services(spark):
    """Two assignments and a factory; the least shared class, two shared interfaces, an unknown service, one type alone."""
    parents = [("A1", "A"), ("A2", "A"), ("A", "Object"), ("A1", "I"), ("A2", "I"), ("I", "Object"), ("B", "Object"), ("A1x", "A1")]
    links = [("s1", "x"), ("x", "y"), ("y", "make"), ("make", "n1"), ("make", "n2"), ("s2", "n1"), ("s3", "nothing"), ("s4", "n1"), ("s4", "n3"), ("s5", "n1"), ("s5", "n4"), ("s6", "n5")]
    types = [("n1", "A1"), ("n2", "A2"), ("n3", "B"), ("n4", "A1x"), ("n5", "Unlisted")]
    sites = [(f"svc{i}", f"s{i}") for i in range(1, 7)]
    df = lambda x, c: spark.createDataFrame(x, ", ".join(f"{n} string" for n in c.split()))
    got = joins.inferred_services(df(sites, "service node"), df(links, "use def"), df(types, "node type"), df(parents, "sub super"), df([("A", "StubA"), ("A1", "StubA1")], "binder stub"))
    assert rows(got) == Counter([("svc1", "A", "StubA"), ("svc1", "I", None), ("svc2", "A1", "StubA1"), ("svc3", None, None), ("svc4", "Object", None), ("svc5", "A1", "StubA1"), ("svc6", "Unlisted", None)])


def test_special_exclusions_of_entry_points(spark):
    """Binders, shell commands and callbacks, each case on its own and the rows that none of them touches."""
    binder, shell, callback = rule_lists.BINDER, rule_lists.SHELL, rule_lists.CALLBACK
    df = lambda x, c: spark.createDataFrame(x, ", ".join(f"{n} string" for n in c.split()))
    parents = [("p.Stub", binder), ("p.Own", "p.Stub"), ("q.Other", binder), ("s.Stub2", binder), ("t.Bare", binder), ("c.In", shell), ("c.Beside", shell), ("c.Far", shell), ("s.Cmd", shell), ("k.One", callback), ("k.Two", callback), ("k.Sub", "k.Two")]
    outers = [("c.In", "p.Own"), ("p.Own", "p.Out"), ("c.Beside", "p.Out"), ("c.Far", "x.Out")]
    on = rule_lists.ON_COMMAND
    methods = [("b.dump", binder, "void dump()"), ("b.tx", binder, "boolean onTransact(int)"), ("own.dump", "p.Own", "void dump()"), ("other.dump", "q.Other", "void dump()"), ("other.tx", "q.Other", "boolean onTransact(int)"), ("other.more", "q.Other", "void more()")]
    methods += [(c, c, on) for c in ("c.In", "c.Beside", "c.Far", "s.Cmd")] + [("cb", callback, "void run(int)"), ("one", "k.One", "void run(int)"), ("two", "k.Two", "void run(int)"), ("sub", "k.Sub", "void run(int)"), ("one.more", "k.One", "void more()")]
    eps = [("e", "p.Stub", binder), ("plain", "p.Stub", "p.Own"), ("f", "s.Stub2", binder), ("g", "t.Bare", binder), ("h", "z.Z", "k.One"), ("r", "z.Z", "z.Routed"), ("self", binder, binder)]
    nodes = [m[0] for m in methods] + ["elsewhere"]
    got = rule_lists.without_special_cases(df([(e[0], n) for e in eps for n in nodes], "ep node"), df(eps, "ep stub class"), df(parents, "sub super"), df(methods, "node class subsig"), df(outers, "class outer"), {"z.Routed": "k.Two"})
    gone = {"e": {"other.dump", "c.Far", "s.Cmd"}, "f": {"own.dump", "other.dump", "c.In", "c.Beside", "c.Far"}, "g": {"own.dump", "other.dump"}, "h": {"two", "sub"}, "r": {"one", "sub"}, "plain": set(), "self": set()}
    assert rows(got) == Counter((e[0], n) for e in eps for n in nodes if n not in gone[e[0]])
