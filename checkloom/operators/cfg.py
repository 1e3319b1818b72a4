"""Per-method control-flow analyses: dominators, control dependence, natural loops, strong components, simple cycles.

A method's flow graph is small, so each is one row of arrays, made from the table (method, src, tgt); Python gets batches of
methods.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Graph = dict[int, set[int]]


def reverse(g: Graph) -> Graph:
    out: Graph = {n: set() for n in g}
    for s, ts in g.items():
        for t in ts:
            out[t].add(s)
    return out


def post_order(g: Graph, root: int) -> list[int]:
    seen, out, stack = {root}, [], [(root, iter(sorted(g.get(root, ()))))]
    while stack:
        node, rest = stack[-1]
        for t in rest:
            if t not in seen:
                seen.add(t)
                stack.append((t, iter(sorted(g[t]))))
                break
        else:
            out.append(node)
            stack.pop()
    return out


def immediate_dominators(g: Graph, root: int) -> dict[int, int]:
    """node -> immediate dominator, for nodes reachable from `root` (Cooper, Harvey, Kennedy)."""
    order = post_order(g, root)
    rank = {n: i for i, n in enumerate(order)}
    back, idom, changed = reverse(g), {root: root}, True
    while changed:
        changed = False
        for n in reversed(order[:-1]):
            new = None
            for p in back[n]:
                if p in idom:
                    if new is None:
                        new = p
                        continue
                    a, b = p, new
                    while a != b:
                        while rank[a] < rank[b]:
                            a = idom[a]
                        while rank[b] < rank[a]:
                            b = idom[b]
                    new = a
            if new is not None and idom.get(n) != new:
                idom[n], changed = new, True
    return idom


def dominators_of(idom: dict[int, int], n: int) -> list[int]:
    out = [n]
    while idom[n] != n:
        n = idom[n]
        out.append(n)
    return out


def immediate_post_dominators(g: Graph) -> tuple[Graph, int, dict[int, int]]:
    """The graph with an exit that all ends lead to, that exit, and node -> immediate post-dominator. Nodes that reach no end
    count as if each cycle's least node could leave."""
    exit_ = min(g, default=0) - 1
    ends = {n for n, ts in g.items() if not ts}
    turned = reverse(g)
    reached = set()
    for n in [*sorted(ends), *sorted(g)]:
        if n not in reached:
            if n not in ends:
                ends.add(n)
            reached |= set(post_order(turned, n))
    full = {n: set(ts) for n, ts in g.items()} | {exit_: set()}
    for n in ends:
        full[n].add(exit_)
    return full, exit_, immediate_dominators(reverse(full), exit_)


def control_dependence(g: Graph) -> set[tuple[int, int]]:
    """(node, branch): node runs or not as branch decides: the frontier of the post-dominator tree."""
    full, exit_, ipdom = immediate_post_dominators(g)
    out = set()
    for b, ts in full.items():
        if len(ts) > 1:
            for t in ts:
                n = t
                while n != ipdom.get(b) and n in ipdom and n != exit_:
                    out.add((n, b))
                    n = ipdom[n]
    return out


def iterated(pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """The transitive closure of (node, branch)."""
    g: Graph = {}
    for n, b in pairs:
        g.setdefault(n, set()).add(b)
        g.setdefault(b, set())
    out = set()
    for n in g:
        seen, stack = set(g[n]), list(g[n])
        while stack:
            for t in g[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        out |= {(n, b) for b in seen}
    return out


def natural_loops(g: Graph, root: int) -> list[tuple[int, list[int], list[int], bool]]:
    """(header, body, exits, simple): back edges end in a dominator; loops of one header are one; simple has one exit."""
    idom, back, found = immediate_dominators(g, root), reverse(g), {}
    for s in idom:
        above = set(dominators_of(idom, s))
        for h in g[s]:
            if h in above:
                body, stack = found.setdefault(h, {h}), [s]
                while stack:
                    n = stack.pop()
                    if n not in body:
                        body.add(n)
                        stack += [p for p in back[n] if p in idom]
    out = []
    for h, body in sorted(found.items()):
        exits = sorted(n for n in body if g[n] - body)
        out.append((h, sorted(body), exits, len(exits) == 1))
    return out


def strong_components(g: Graph) -> list[list[int]]:
    """Kosaraju, each sorted, by least node."""
    order, seen = [], set()
    for n in sorted(g):
        if n not in seen:
            part = [x for x in post_order(g, n) if x not in seen]
            seen |= set(part)
            order += part
    turned, done, out = reverse(g), set(), []
    for n in reversed(order):
        if n not in done:
            stack, part = [n], []
            done.add(n)
            while stack:
                x = stack.pop()
                part.append(x)
                for t in turned[x]:
                    if t not in done:
                        done.add(t)
                        stack.append(t)
            out.append(sorted(part))
    return sorted(out)


def simple_cycles(g: Graph, limit: int | None = None) -> list[list[int]]:
    """Elementary cycles, each from its least node; `limit` is the number after which an error is raised, not a cap."""
    out: list[list[int]] = []
    for part in strong_components(g):
        inside = set(part)
        for start in part:
            path, stack = [start], [iter(sorted(t for t in g[start] if t in inside and t >= start))]
            while stack:
                for t in stack[-1]:
                    if t == start:
                        out.append(list(path))
                        if limit is not None and len(out) > limit:
                            raise OverflowError("too many cycles")
                    elif t not in path:
                        path.append(t)
                        stack.append(iter(sorted(x for x in g[t] if x in inside and x >= start)))
                        break
                else:
                    stack.pop()
                    path.pop()
    return sorted(out)


def _graph_of(src: list, tgt: list) -> Graph:
    g: Graph = {}
    for s, t in zip(src, tgt, strict=True):
        g.setdefault(s, set())
        if t is not None:
            g[s].add(t)
            g.setdefault(t, set())
    return g


#: Results of so many different flow graphs are kept by a task: methods often have the same few shapes.
SHAPES = 16384


def _per_method(flow: DataFrame, fn, schema: str, cases: DataFrame | None = None) -> DataFrame:
    """`fn` of each method's graph, rows of `schema` after the method. A method is one row of two arrays, so that Python sees
    batches of methods and no group costs a call of its own. With `cases` (method, c struct) `fn` also gets the
    method's cases as sorted tuples; methods that have only cases have an empty graph."""
    out = StructType.fromDDL(schema)
    types = to_arrow_schema(out)
    arcs = flow.select("method", F.struct(F.col("src").cast("long").alias("src"), F.col("tgt").cast("long").alias("tgt")).alias("a"))
    if cases is None:
        packed = arcs.groupBy("method").agg(F.sort_array(F.collect_set("a")).alias("a")).select("method", "a.src", "a.tgt")
    else:
        both = arcs.withColumn("c", F.lit(None).cast(cases.schema["c"].dataType)).unionByName(cases.select("method", F.lit(None).cast(arcs.schema["a"].dataType).alias("a"), "c"))
        packed = both.groupBy("method").agg(F.sort_array(F.collect_set("a")).alias("a"), F.sort_array(F.collect_set("c")).alias("c")).select("method", "a.src", "a.tgt", "c")

    alone = cases is None

    def run(batches):
        @lru_cache(SHAPES)
        def columns(src, tgt, more):
            found = fn(_graph_of(src, tgt)) if more is None else fn(_graph_of(src, tgt), more)
            return len(found), found and [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(types)[1:], strict=True)]

        def together(batch, at, parts):
            index = pa.array(np.repeat([k for k, _ in at], [n for _, n in at]))
            method = batch.column("method").take(index).cast(types.field(0).type)
            return pa.RecordBatch.from_arrays([method, *[pa.concat_arrays(c) for c in zip(*parts, strict=True)]], schema=types)

        for batch in batches:
            src, tgt = batch.column("src").to_pylist(), batch.column("tgt").to_pylist()
            more = [None] * len(src) if alone else [tuple(tuple(c.values()) for c in cs) for cs in batch.column("c").to_pylist()]
            at, parts, held = [], [], 0
            for k in range(len(src)):
                n, cols = columns(tuple(src[k]), tuple(tgt[k]), more[k])
                if n:
                    at.append((k, n))
                    parts.append(cols)
                    held += n
                if parts and (held >= 100_000 or k == len(src) - 1):
                    yield together(batch, at, parts)
                    at, parts, held = [], [], 0

    return packed.mapInArrow(run, out)


def dominators(flow: DataFrame) -> DataFrame:
    """(method, node, dominator) over (method, src, tgt); a method begins at its least node."""
    def fn(g):
        idom = immediate_dominators(g, min(g))
        return [(n, d) for n in idom for d in dominators_of(idom, n)]

    return _per_method(flow, fn, "method string, node long, dominator long")


def post_dominators(flow: DataFrame) -> DataFrame:
    """(method, node, dominator): statements that every way from a node to an end meets, itself included."""
    def fn(g):
        _, exit_, ipdom = immediate_post_dominators(g)
        return [(n, d) for n in g for d in dominators_of(ipdom, n) if d != exit_]

    return _per_method(flow, fn, "method string, node long, dominator long")


def joins_of(g: Graph) -> dict[int, int | None]:
    """branch -> where its ways meet: their lowest common ancestor in the post-dominator tree, None behind the ends."""
    full, exit_, ipdom = immediate_post_dominators(g)
    depth: dict[int, int] = {exit_: 0}
    for n in full:
        way = []
        while n not in depth:
            way.append(n)
            n = ipdom[n]
        for m in reversed(way):
            depth[m] = depth[ipdom[m]] + 1

    def common(a: int, b: int) -> int:
        while a != b:
            a, b = (ipdom[a], b) if depth[a] >= depth[b] else (a, ipdom[b])
        return a

    return {n: None if (j := reduce(common, ts)) == exit_ else j for n, ts in full.items() if n != exit_ and len(ts) > 1}


def join_points(flow: DataFrame) -> DataFrame:
    """(method, branch, join): where the ways that part at a statement with several successors meet again: their lowest common
    ancestor in the post-dominator tree. Null if they meet only behind the method's ends."""
    return _per_method(flow, lambda g: list(joins_of(g).items()), "method string, branch long, join long")


def blocks_of(g: Graph, cases: tuple) -> list[tuple]:
    """(branch, tx, stmt) of the cases (branch, tx, stmt): what a case reaches before its branch's ways meet."""
    joins, firsts = joins_of(g) if g else {}, {}
    for branch, tx, stmt in cases:
        firsts.setdefault((branch, tx), []).append(stmt)
    out = []
    for (branch, tx), stmts in firsts.items():
        stop = joins.get(branch)
        seen = {s for s in stmts if s != stop}
        stack = list(seen)
        while stack:
            for t in g.get(stack.pop(), ()):
                if t != stop and t not in seen:
                    seen.add(t)
                    stack.append(t)
        out += [(branch, tx, s) for s in sorted(seen)]
    return out


def branch_blocks(flow: DataFrame, cases: DataFrame) -> DataFrame:
    """(method, branch, tx, stmt): the statements of each case of a branch (switch or if) before its cases join, which is found
    from the flow (method, src, tgt). cases: method, branch, tx, stmt (the case's first statement)."""
    kinds = dict(cases.dtypes)
    # a case may be named by a text
    c = cases.select("method", F.struct(F.col("branch").cast("long").alias("branch"), F.col("tx").cast("string").alias("tx"), F.col("stmt").cast("long").alias("stmt")).alias("c"))
    found = _per_method(flow.where("tgt is not null"), blocks_of, "method string, branch long, tx string, stmt long", c)
    return found.select("method", F.col("branch").cast(kinds["branch"]).alias("branch"), F.col("tx").cast(kinds["tx"]).alias("tx"), "stmt")


def control_dependences(flow: DataFrame, closure: bool = False) -> DataFrame:
    """(method, node, branch), iterated if `closure`."""
    def fn(g):
        pairs = control_dependence(g)
        return sorted(iterated(pairs) if closure else pairs)

    return _per_method(flow, fn, "method string, node long, branch long")


def loops(flow: DataFrame) -> DataFrame:
    return _per_method(flow, lambda g: natural_loops(g, min(g)), "method string, header long, body array<long>, exits array<long>, simple boolean")


def cycles(flow: DataFrame) -> DataFrame:
    return _per_method(flow, lambda g: [(c,) for c in simple_cycles(g)], "method string, cycle array<long>")


def components_of_methods(flow: DataFrame) -> DataFrame:
    return _per_method(flow, lambda g: [(c,) for c in strong_components(g)], "method string, nodes array<long>")


def predecessors(flow: DataFrame) -> DataFrame:
    """(method, node, before): every node from which a node is reached."""
    def fn(g):
        turned = reverse(g)
        return sorted({(n, b) for n in g for p in turned[n] for b in post_order(turned, p)})

    return _per_method(flow, fn, "method string, node long, before long")


def flow_view(flow: DataFrame, logic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (method, id, color) and edges (method, src, tgt) of methods' flow graphs, statements of `logic` (method, id) red."""
    n = flow.select("method", F.col("src").alias("id")).union(flow.where("tgt is not null").select("method", "tgt")).distinct()
    marked = logic.select("method", "id", F.lit("red").alias("mark")).distinct()
    return n.join(marked, ["method", "id"], "left").select("method", "id", F.coalesce("mark", F.lit("white")).alias("color")), flow.where("tgt is not null").select("method", "src", "tgt").distinct()
