"""Filter entries and restrictions over def-use facts: sets of nodes as tables, narrowed by semi-joins.

Facts: du_nodes(ep, node, kind, method, expr_op, target, field, type, const), du_edges(ep, use, def), call_args(ep,
node, pos, def) with pos -1 for the receiver; starts(ep, start) are the control predicates under test. A restriction
takes and gives tables (ep, start, node).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.operators.graph import REACH_CUT, reach, subclasses
from checkloom.plans.shared import cut

Restriction = Callable[[DataFrame], DataFrame]
# Operators that form an arithmetic chain, and those a value may be tested under.
CHAIN_OPS = ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>", "cmp", "cmpl", "cmpg", "==", "!=", "<", "<=", ">", ">=", "neg", "local", "param")
BINARY_OPS = ("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>", "cmp", "cmpl", "cmpg", "==", "!=", "<", "<=", ">", ">=", "instanceof")


def used_nodes(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(ep, start, node): every node reached from a start by use -> def."""
    one = lambda a, b: F.concat_ws("\u0001", F.col(a).cast("string"), F.col(b).cast("string"))
    seeds = starts.select(one("ep", "start").alias("ep"), one("ep", "start").alias("node"))
    g = edges.select(one("ep", "use").alias("src"), one("ep", "def").alias("tgt"))
    r = reach(g, seeds)
    part = lambda c, i: F.split(c, "\u0001")[i]
    return r.select(part("ep", 0).alias("ep"), part("ep", 1).cast("long").alias("start"), part("node", 1).cast("long").alias("node"))


def used_values(starts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ep, start, kind, value): the kinds and values of what each start uses, once each; nodes: ep, node, kind, value. Values go up
    to the starts, so many nodes of one value are one row from their first common user on."""
    keys = ["ep", "node", "kind", "value"]
    up = edges.select("ep", F.col("def").alias("node"), "use")
    seen = frontier = cut(nodes.select(*keys).distinct(), "values")
    level = 0
    while True:
        step = up.join(frontier, ["ep", "node"]).select("ep", F.col("use").alias("node"), "kind", "value").distinct()
        same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in keys]
        frontier = cut(step.join(seen.select(*[F.col(c).alias(f"_{c}") for c in keys]), same, "left_anti"), "values")
        if frontier.isEmpty():
            break
        seen, level = seen.unionByName(frontier), level + 1
        seen = cut(seen, "values") if level % REACH_CUT == 0 else seen
    return starts.select("ep", "start").distinct().join(seen.withColumnRenamed("node", "start"), ["ep", "start"]).select("ep", "start", "kind", "value")


def users(edges: DataFrame, hits: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """(ep, node): `hits` (ep, node) and all nodes from which one of them is reached by use -> def; with `through` (ep, node) only
    over nodes of that, though the last one may be any. A node is met once, whichever hits it leads to, so this grows with the
    graph and not with the pairs of starts and hits. Every level meets the edges: a table of them in buckets by (ep, def) is best."""
    up = edges.select("ep", F.col("def").alias("node"), "use")
    seen = frontier = cut(hits.select("ep", "node").distinct(), "users")
    level = 0
    while True:
        step = up.join(frontier, ["ep", "node"], "left_semi").select("ep", F.col("use").alias("node")).distinct()
        # nothing leads on from a node that is not there to be passed
        new = cut(step.join(seen, ["ep", "node"], "left_anti"), "users")
        level += 1
        frontier = new if through is None else cut(new.join(through, ["ep", "node"], "left_semi"), "users")
        seen = seen.unionByName(new)
        if frontier.isEmpty():
            return seen
        if level % REACH_CUT == 0:
            seen = cut(seen, "users")


def _by_nodes(run: Restriction) -> Restriction:
    """Marks a restriction that looks at nodes alone, whatever starts they are used by."""
    run.by_nodes = True
    return run


def _over_nodes(x: DataFrame) -> DataFrame:
    return x.select("ep", F.lit(0).cast("long").alias("start"), "node")


def keep_use(starts: DataFrame, nodes: DataFrame, edges: DataFrame, matching: Column, restriction: Restriction | None = None) -> DataFrame:
    """Starts that use a node for which `matching` holds and that the restriction leaves. `matching` is over du_nodes.

    Where a restriction looks at nodes alone, or is a chain of arithmetic at the end of such, the nodes are narrowed first and
    then only their users are looked for; others need the pairs of starts and nodes."""
    fit = nodes.where(matching).select("ep", "node")
    through = getattr(restriction, "through", None)
    if restriction is None or through is not None or getattr(restriction, "by_nodes", False):
        if restriction is not None and through is None:
            fit = restriction(_over_nodes(fit)).select("ep", "node")
        found = users(edges, fit, through)
        return starts.join(found.select("ep", F.col("node").alias("start")).distinct(), ["ep", "start"], "left_semi")
    hit = restriction(used_nodes(starts, edges).join(fit, ["ep", "node"]))
    return starts.join(hit.select("ep", "start").distinct(), ["ep", "start"], "left_semi")


def keep_method_return_use(starts, nodes, edges, matcher: Column, restriction=None) -> DataFrame:
    return keep_use(starts, nodes, edges, (F.col("kind") == "invoke") & matcher, restriction)


def keep_context_query_use(starts, nodes, edges, queries: DataFrame, restriction=None) -> DataFrame:
    """As above for calls of context queries (target)."""
    return keep_use(starts, nodes.where("kind = 'invoke'").join(queries.select("target"), "target", "left_semi"), edges, F.lit(True), restriction)


def keep_field_use(starts, nodes, edges, matcher: Column, restriction=None) -> DataFrame:
    return keep_use(starts, nodes, edges, (F.col("kind") == "field") & matcher, restriction)


def keep_number_use(starts, nodes, edges, matcher: Column, restriction=None) -> DataFrame:
    return keep_use(starts, nodes, edges, (F.col("kind") == "const") & matcher, restriction)


def keep_method_is(methods: DataFrame, matcher: Column) -> DataFrame:
    return methods.where(matcher)


def keep_source_method_is(starts: DataFrame, sources: DataFrame, matcher: Column) -> DataFrame:
    """sources: ep, start, sig."""
    return starts.join(sources.where(matcher), ["ep", "start"], "left_semi")


def keep_in_query_subgraph(starts: DataFrame, sources: DataFrame, queries: DataFrame, subgraphs: DataFrame | None) -> DataFrame:
    """Starts whose method is a context query (target) or, unless subgraphs is None, in one's subgraph (ep, method)."""
    s = sources.select("ep", "start", F.col("sig").alias("method"))
    found = s.join(queries.select(F.col("target").alias("method")), "method", "left_semi").select("ep", "start")
    if subgraphs is not None:
        found = found.unionByName(s.join(subgraphs, ["ep", "method"], "left_semi").select("ep", "start"))
    return starts.join(found.distinct(), ["ep", "start"], "left_semi")


Entry = Callable[[DataFrame], DataFrame]


def all_entries(*entries: Entry) -> Entry:
    """Starts that every entry keeps. An entry takes and gives a table (ep, start, ..)."""
    def run(starts):
        for e in entries:
            starts = e(starts)
        return starts

    return run


def any_entry(*entries: Entry) -> Entry:
    """Starts that some entry keeps."""
    def run(starts):
        kept = entries[0](starts).select("ep", "start")
        for e in entries[1:]:
            kept = kept.unionByName(e(starts).select("ep", "start"))
        return starts.join(kept.distinct(), ["ep", "start"], "left_semi")

    return run


def not_entry(entry: Entry) -> Entry:
    """Starts that the entry drops."""
    return lambda starts: starts.join(entry(starts).select("ep", "start"), ["ep", "start"], "left_anti")


def keep_loop_header(starts: DataFrame, positions: DataFrame, loops: DataFrame, children: DataFrame) -> DataFrame:
    """Starts at an exit of a loop that is simple, or that test a length, an increment or a listed method directly.
    positions: ep, start, method, idx; loops: method, exit_idx, simple; children: ep, start, child_kind."""
    at = positions.join(loops, (positions["method"] == loops["method"]) & (F.col("idx") == F.col("exit_idx"))).select("ep", "start", "simple")
    direct = children.where(F.col("child_kind").isin("length", "increment", "listed")).select("ep", "start").distinct()
    ok = at.where("simple").select("ep", "start").unionByName(at.select("ep", "start").join(direct, ["ep", "start"], "left_semi"))
    return starts.join(ok.distinct(), ["ep", "start"], "left_semi")


def union_of(*parts: Restriction) -> Restriction:
    def run(x):
        out = parts[0](x)
        for p in parts[1:]:
            out = out.unionByName(p(x))
        return out.distinct()

    return _by_nodes(run) if all(getattr(p, "by_nodes", False) for p in parts) else run


def sequence_of(*parts: Restriction) -> Restriction:
    def run(x):
        for p in parts:
            x = p(x)
        return x

    return _by_nodes(run) if all(getattr(p, "by_nodes", False) for p in parts) else run


def in_arithmetic_chain(nodes: DataFrame, edges: DataFrame, constants: Column | None = None) -> Restriction:
    """Nodes with a use path to the start on which all in between is arithmetic. constants: a test that some constant
    used on the path must pass (over du_nodes)."""
    plain = nodes.where(F.col("expr_op").isin(*CHAIN_OPS)).select("ep", F.col("node").alias("use"))
    if constants is not None:
        fit = edges.join(nodes.where((F.col("kind") == "const") & constants).select("ep", F.col("node").alias("def")), ["ep", "def"]).select("ep", "use").distinct()
        plain = plain.join(fit, ["ep", "use"], "left_semi")

    def run(x):
        seen = cut(x.select("ep", "start", "node").distinct().withColumn("at", F.col("node")), "chain")
        frontier = seen
        while True:
            up = frontier.join(edges.select("ep", F.col("def").alias("at"), "use"), ["ep", "at"]).select("ep", "start", "node", F.col("use").alias("to"))
            up = up.join(plain.select("ep", F.col("use").alias("to")), ["ep", "to"], "left_semi").unionByName(up.where("to = start"))
            frontier = cut(up.select("ep", "start", "node", F.col("to").alias("at")).distinct().join(seen, ["ep", "start", "node", "at"], "left_anti"), "chain")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen.where("at = start").select("ep", "start", "node").distinct()

    run.through = plain.select("ep", F.col("use").alias("node"))
    return run


def in_arithmetic_op(nodes: DataFrame, edges: DataFrame, op: str) -> Restriction:
    """Nodes used directly, or over one local, by `op`; == also by a switch."""
    def run(x):
        wanted = nodes.where(F.col("expr_op").isin(*([op, "switch"] if op == "==" else [op]))).select("ep", F.col("node").alias("use"))
        direct = edges.join(wanted, ["ep", "use"], "left_semi").select("ep", F.col("def").alias("node"))
        local = nodes.where("expr_op = 'local'").select("ep", "node").join(direct, ["ep", "node"], "left_semi")
        hop = edges.join(local.select("ep", F.col("node").alias("use")), ["ep", "use"], "left_semi").select("ep", F.col("def").alias("node"))
        return x.join(direct.unionByName(hop).distinct(), ["ep", "node"], "left_semi").select("ep", "start", "node")

    return _by_nodes(run)


def used_in_call(nodes: DataFrame, args: DataFrame, pos: int, matcher: Column) -> Restriction:
    """Nodes that are argument `pos` (-1: the receiver) of a call that `matcher` (over du_nodes) picks; array elements
    are followed one hop."""
    def run(x):
        calls = nodes.where((F.col("kind") == "invoke") & matcher).select("ep", "node")
        own = args.where(F.col("pos") == pos).join(calls, ["ep", "node"], "left_semi").select("ep", F.col("def").alias("node"))
        array = nodes.where("expr_op = 'arrayref'").select("ep", "node", F.col("base").alias("def")) if "base" in nodes.columns else None
        if array is not None:
            own = own.unionByName(array.join(own, ["ep", "node"], "left_semi").select("ep", F.col("def").alias("node")))
        return x.join(own.distinct(), ["ep", "node"], "left_semi").select("ep", "start", "node")

    return _by_nodes(run)


def argument_is(nodes: DataFrame, args: DataFrame, pos: int, test: Column, inner: Restriction | None = None) -> Restriction:
    """Calls whose argument `pos` (-1: the receiver) is defined by a node for which `test` (over du_nodes) holds and that
    `inner` leaves; array elements are followed to their arrays, one hop. Nodes that are no calls go."""
    def run(x):
        own = x.join(args.where(F.col("pos") == pos).select("ep", "node", "def"), ["ep", "node"])
        if "base" in nodes.columns:
            array = nodes.where("expr_op = 'arrayref'").select("ep", F.col("node").alias("def"), "base")
            own = own.join(array, ["ep", "def"], "left").withColumn("def", F.coalesce("base", "def")).drop("base")
        own = own.join(nodes.where(test).select("ep", F.col("node").alias("def")), ["ep", "def"], "left_semi")
        if inner is not None:
            left = inner(own.select("ep", "start", F.col("def").alias("node")).distinct()).select("ep", "start", F.col("node").alias("def"))
            own = own.join(left, ["ep", "start", "def"], "left_semi")
        return own.select("ep", "start", "node").distinct()

    return _by_nodes(run) if inner is None or getattr(inner, "by_nodes", False) else run


def by_node(nodes: DataFrame, test: Column) -> Restriction:
    """Nodes for which a test over du_nodes holds: field type, method return type, declaring class."""
    return _by_nodes(lambda x: x.join(nodes.where(test).select("ep", "node"), ["ep", "node"], "left_semi").select("ep", "start", "node"))


def declaring_class(nodes: DataFrame, cls: str, parents: DataFrame | None = None) -> Restriction:
    """Calls of methods of `cls`, or of its subclasses if direct (sub, super) rows are given. Needs du_nodes.class."""
    if parents is None:
        return by_node(nodes, F.col("class") == cls)
    below = subclasses(parents).where(F.col("super") == cls).select(F.col("sub").alias("class")).distinct()
    return _by_nodes(lambda x: x.join(nodes.join(below, "class", "left_semi").select("ep", "node"), ["ep", "node"], "left_semi").select("ep", "start", "node"))


def used_beside(nodes: DataFrame, edges: DataFrame, kind: str, matcher: Column) -> Restriction:
    """Nodes whose user also uses a node of `kind` (invoke, field) that `matcher` picks, other than the node itself."""
    def run(x):
        other = edges.join(nodes.where((F.col("kind") == kind) & matcher).select("ep", F.col("node").alias("def")), ["ep", "def"], "left_semi").select("ep", "use", F.col("def").alias("other"))
        # both sides are narrowed to what fits before they meet by their user
        mine = edges.select("ep", "use", F.col("def").alias("node")).join(x.select("ep", "node").distinct(), ["ep", "node"], "left_semi")
        own = mine.join(other, ["ep", "use"]).where("node <> other").select("ep", "node").distinct()
        return x.join(own, ["ep", "node"], "left_semi").select("ep", "start", "node")

    return _by_nodes(run)


def number_used(nodes: DataFrame, edges: DataFrame, test: Callable[[Column], Column], cases: DataFrame | None = None) -> Restriction:
    """Nodes whose user has a numeric operand for which `test` holds, or a switch case of `cases` (ep, use, value) for
    which it does; the highest case counts as well."""
    def run(x):
        use = edges.join(nodes.where((F.col("kind") == "const") & test(F.col("const"))).select("ep", F.col("node").alias("def")), ["ep", "def"], "left_semi").select("ep", "use")
        if cases is not None:
            use = use.unionByName(cases.where(test(F.col("value"))).select("ep", "use"))
        own = edges.join(use.distinct(), ["ep", "use"], "left_semi").select("ep", F.col("def").alias("node")).distinct()
        return x.join(own, ["ep", "node"], "left_semi").select("ep", "start", "node")

    return _by_nodes(run)
