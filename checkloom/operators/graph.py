"""Graph operators over edge tables (src, tgt): level-synchronous closures, components, subgraph reports.

Every level is cut to the shared folder, so plans stay short and a lost executor costs no recomputation. Sources are
carried as a column, so that one closure serves all entry points at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.plans.shared import bucketed, cut


#: A closure of many levels becomes one table again after so many of them.
REACH_CUT = 8


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star step over undirected edges (a, b), a > b."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
    large = (both.join(low, both.a == low.u).where("b > u and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    keep = low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
    one = large.union(keep).distinct()
    floor = one.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = one.join(floor, one.a == floor.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(floor.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): rows (id, component), component the smallest id reachable.

    Alternating large-star and small-star steps; every step is cut to the shared folder, nothing is collected but two
    totals that tell whether the edges still change. Self links and repeats are harmless; an empty input gives no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = cut(e, "edges")
    total = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    before = e.agg(total.alias("t")).first().t
    while before.n:
        e = cut(_stars(e), "edges")
        now = e.agg(total.alias("t")).first().t
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def reach(edges: DataFrame, seeds: DataFrame, excluded: DataFrame | None = None, mode: str = "leaf", max_level: int | None = None, table: bool = False) -> DataFrame:
    """(ep, node, level): nodes reachable from each seed (ep, node), with the least number of edges; seeds have level 0.

    excluded: a table (node), or (ep, node) for nodes excluded for one entry point only. mode "leaf": excluded nodes
    are reached but not expanded; "drop": they are not reached at all. table: the edges are `bucketed` by src already, else
    they become so here, since every level meets all of them.
    """
    e = edges.select("src", "tgt") if table else bucketed(edges.select("src", "tgt"), "src", label="edges")
    keys = ["ep", "node"] if excluded is not None and "ep" in excluded.columns else ["node"]

    def without(df):
        return df if excluded is None else df.join(excluded.select(*keys).distinct(), keys, "left_anti")

    seen = seeds.select("ep", "node").distinct()
    seen = cut((without(seen) if mode == "drop" else seen).withColumn("level", F.lit(0)), "reach")
    frontier, level = seen, 0
    while max_level is None or level < max_level:
        step = without(frontier).select("ep", "node").join(e, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node")).distinct()
        step = without(step) if mode == "drop" else step
        level += 1
        frontier = cut(step.join(seen, ["ep", "node"], "left_anti").withColumn("level", F.lit(level)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % REACH_CUT == 0:
            seen = cut(seen, "reach")
    return seen.select("ep", "node", "level")


def _packed(batches, size: int):
    """Edges (src, tgt), both numbers, as rows (sb, tb, codes): the different edges between two blocks of `size` nodes, packed as
    place of tgt * size + place of src. A task packs what it has read so far when that is 4 million edges."""
    import numpy as np
    import pyarrow as pa

    def pack(src, tgt):
        src, tgt = np.concatenate(src), np.concatenate(tgt)
        block, code = (src // size << 32) | tgt // size, tgt % size * size + src % size
        order = np.lexsort((code, block))
        block, code = block[order], code[order]
        new = np.ones(len(block), bool)
        new[1:] = (block[1:] != block[:-1]) | (code[1:] != code[:-1])
        block, code = block[new], code[new].astype("<u4")
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        codes = [x.tobytes() for x in np.split(code, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array((block[at] >> 32).astype("i4")), pa.array((block[at] & 0xFFFFFFFF).astype("i4")), pa.array(codes, pa.binary())], names=["sb", "tb", "codes"])

    src, tgt, n = [], [], 0
    for x in batches:
        src.append(x.column(0).to_numpy(zero_copy_only=False))
        tgt.append(x.column(1).to_numpy(zero_copy_only=False))
        n += len(src[-1])
        if n >= 4_000_000:
            yield pack(src, tgt)
            src, tgt, n = [], [], 0
    if n:
        yield pack(src, tgt)


def _tile_step(edges, bits, size: int, words: int):
    """What the edges between pairs of blocks add: rows (tb, g, bits), for one block of targets and one group of entry points."""
    import numpy as np
    import pandas as pd

    of = {k: np.frombuffer(x, "<u8").reshape(size, words) for k, x in zip(bits["sb"], bits["bits"])}
    out = np.zeros((size, words), "<u8")
    for sb, codes in zip(edges["sb"], edges["codes"]):
        code, step = np.frombuffer(codes, "<u4"), max(1, (1 << 17) // words)
        for i in range(0, len(code), step):  # edges in order of their targets, as many as the processor's cache holds
            tgt, src = np.divmod(code[i : i + step], size)
            at = np.flatnonzero(np.concatenate([[True], tgt[1:] != tgt[:-1]]))
            out[tgt[at]] |= np.bitwise_or.reduceat(of[sb][src], at, axis=0)
    row = (edges if len(edges) else bits).iloc[0]
    return pd.DataFrame({"tb": [row["tb"]], "g": [row["g"]], "bits": [out.tobytes()]})


def _tile_seen(parts, seen, size: int, words: int, nodes: int, eps: int):
    """What is new in a tile, and all that it holds: rows (tb, g, bits, seen, whole); bits are null without news, seen is null for a
    tile that is whole, since nothing can be new there."""
    import numpy as np
    import pandas as pd

    row = (parts if len(parts) else seen).iloc[0]
    had = np.frombuffer(seen["seen"].iloc[0], "<u8") if len(seen) else np.zeros(size * words, "<u8")
    new = np.zeros(size * words, "<u8")
    for x in parts["bits"]:
        new |= np.frombuffer(x, "<u8")
    new &= ~had
    had = had | new
    full = min(size, nodes - int(row["tb"]) * size) * min(words * 64, eps - int(row["g"]) * words * 64)
    whole = int(np.bitwise_count(had).sum()) == full
    return pd.DataFrame({"tb": [row["tb"]], "g": [row["g"]], "bits": [new.tobytes() if new.any() else None], "seen": [None if whole else had.tobytes()], "whole": [whole]})


def _tile_rows(batches, size: int, words: int):
    """The pairs of tiles (level, bits, nodes, eps) as rows (ep, node, level); nodes and eps are what a tile's places stand for."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for r in range(b.num_rows):
            nodes, eps = b.column(2)[r].values, b.column(3)[r].values
            bits = np.frombuffer(b.column(1)[r].as_buffer(), "u1").reshape(size, words * 8)
            step = max(1, (1 << 19) // (words * 64))
            for i in range(0, len(nodes), step):
                node, ep = np.divmod(np.flatnonzero(np.unpackbits(bits[i : i + step], bitorder="little")), words * 64)
                if len(ep):
                    level = pa.array(np.full(len(ep), b.column(0)[r].as_py(), "i4"))
                    yield pa.RecordBatch.from_arrays([eps.take(pa.array(ep)), nodes.take(pa.array(node + i)), level], names=["ep", "node", "level"])


#: Nodes of a block and words of 64 entry points of a group, in a tile of `reach_dense`; blocks whose edges a task holds at once.
BLOCK, WORDS, HELD_BLOCKS = 8192, 64, 16


def reach_dense(edges: DataFrame, seeds: DataFrame, max_level: int | None = None) -> DataFrame:
    """(ep, node, level): as `reach`, for many entry points in a dense graph. Nodes and entry points are numbered in order. A tile
    is a block of nodes and a group of entry points with a bit for each pair, and edges are lists for each pair of blocks. So a
    level is a product of matrices by tiles, where edges that share nodes are never joined to rows: tiles meet the lists by
    shuffle, and a task holds one tile of results and what HELD_BLOCKS blocks bring to it. Tiles without pairs are not there,
    those with all pairs get nothing more, and pairs become rows at the end only, without a shuffle."""
    from checkloom.operators.order import placed

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = BLOCK
    e = cut(edges.select("src", "tgt").where("src is not null and tgt is not null"), "dense")
    seeds = seeds.select("ep", "node").where("ep is not null and node is not null")
    number = lambda df, c: cut(placed(df.distinct(), c).select(c, (F.col("place") - 1).alias("id")), "dense")
    nodes, eps = number(seeds.select("node").union(e.select("src")).union(e.select("tgt")), "node"), number(seeds.select("ep"), "ep")
    n_nodes, n_eps = nodes.count(), eps.count()
    words = max(1, min(WORDS, -(-n_eps // 64)))
    group = words * 64
    key = lambda df, c: df.join(nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c)
    pairs = key(key(e, "src"), "tgt").select("src_id", "tgt_id")
    lists = cut(pairs.mapInArrow(lambda x: _packed(x, size), "sb int, tb int, codes binary"), "lists")
    met = cut(lists.select("sb", "tb").distinct(), "blocks")
    own = key(seeds, "node").join(eps, "ep").select(F.floor(F.col("node_id") / size).cast("int").alias("tb"), F.floor(F.col("id") / group).cast("int").alias("g"), (F.col("node_id") % size * group + F.col("id") % group).alias("at"))

    def first(rows):
        import numpy as np
        import pandas as pd

        bits = np.zeros(size * group, "u1")
        bits[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"tb": rows["tb"].iloc[:1], "g": rows["g"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    tile, state = "tb int, g int, bits binary", "tb int, g int, bits binary, seen binary, whole boolean"
    dealt = lambda df, *keys: df.repartition(n, *keys).groupBy(*keys)
    seen = lambda parts, had: cut(dealt(parts, "tb", "g").cogroup(dealt(had, "tb", "g")).applyInPandas(lambda a, b: _tile_seen(a, b, size, words, n_nodes, n_eps), state), "tiles")
    now = dealt(own, "tb", "g").applyInPandas(first, tile)
    now = seen(now, edges.sparkSession.createDataFrame([], "tb int, g int, seen binary"))
    whole, levels, level = [], [], 0
    while not now.where("bits is not null").isEmpty():
        levels.append(now.where("bits is not null").select("tb", "g", "bits").withColumn("level", F.lit(level)))
        whole.append(now.where("whole").select("tb", "g"))
        if max_level is not None and level >= max_level:
            break
        level += 1
        front = levels[-1].select(F.col("tb").alias("sb"), "g", "bits")
        open_ = lambda df: df.join(F.broadcast(done), ["tb", "g"], "left_anti").withColumn("part", F.floor(F.col("sb") / HELD_BLOCKS))
        there, done = cut(front.select("sb", "g"), "blocks"), cut(union_all(whole), "blocks")
        left, right = open_(lists.join(there, "sb")), open_(front.join(met, "sb"))
        parts = dealt(left, "tb", "g", "part").cogroup(dealt(right, "tb", "g", "part")).applyInPandas(lambda a, b: _tile_step(a, b, size, words), tile)
        now = seen(parts, now.where("not whole").select("tb", "g", "seen"))
    schema = [f.simpleString().replace(":", " ", 1) for f in (eps.schema["ep"], nodes.schema["node"])]
    names = lambda df, c, size, key, out: cut(df.groupBy(F.floor(F.col("id") / size).cast("int").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", c))), lambda x: x[c]).alias(out)), "names")
    if not levels:
        return seeds.withColumn("level", F.lit(0)).limit(0)
    each = union_all(levels).join(names(nodes, "node", size, "tb", "nodes"), "tb").join(names(eps, "ep", group, "g", "eps"), "g").select("level", "bits", "nodes", "eps")
    return each.mapInArrow(lambda x: _tile_rows(x, size, words), f"{schema[0]}, {schema[1]}, level int")


def allowed_edges(edges: DataFrame, reached: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(ep, src, tgt): edges that leave an expanded node of each entry point's closure."""
    keys = ["ep", "node"] if excluded is not None and "ep" in excluded.columns else ["node"]
    grown = reached if excluded is None else reached.join(excluded.select(*keys).distinct(), keys, "left_anti")
    return grown.select("ep", F.col("node").alias("src")).join(edges.select("src", "tgt").distinct(), "src").select("ep", "src", "tgt")


def reach_back(allowed: DataFrame, sinks: DataFrame) -> DataFrame:
    """(ep, sink, node): nodes from which each sink is reached over the entry point's allowed edges; sinks included."""
    turned = allowed.select("ep", F.col("tgt").alias("s"), F.col("src").alias("t"))
    seen = cut(allowed.select("ep", F.col("tgt").alias("sink")).join(sinks.select("sink"), "sink", "left_semi").distinct().select("ep", "sink", F.col("sink").alias("node")), "back")
    frontier, level = seen, 0
    while True:
        level += 1
        step = frontier.join(turned, (frontier["ep"] == turned["ep"]) & (frontier["node"] == turned["s"])).select(frontier["ep"], "sink", F.col("t").alias("node")).distinct()
        frontier = cut(step.join(seen, ["ep", "sink", "node"], "left_anti"), "back")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if level % REACH_CUT == 0:
            seen = cut(seen, "back")


def depth_sets(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(ep, node, depth): a node's level, and level(src) + 1 of every allowed edge into it."""
    again = reached.join(edges.select("src", "tgt").distinct(), F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node"), (F.col("level") + 1).alias("depth"))
    return reached.select("ep", "node", F.col("level").alias("depth")).union(again).distinct()


def throw_marks(depths: DataFrame, flow: DataFrame, throws: DataFrame, parents: DataFrame, root: str) -> DataFrame:
    """(ep, method, stmt, type, depths): throws of `root` or of what is below it that leave their method, in the methods of each
    entry point's closure. depths: ep, node, depth (as from `depth_sets`); flow: method, src, tgt; throws: method, stmt, type;
    parents: direct (sub, super). A throw that the method itself handles has a successor in its flow and is none."""
    below = subclasses(parents).where(F.col("super") == root).select(F.col("sub").alias("type")).union(throws.where(F.col("type") == root).select("type")).distinct()
    led = flow.where("tgt is not null").select("method", F.col("src").alias("stmt")).distinct()
    own = throws.join(below, "type", "left_semi").join(led, ["method", "stmt"], "left_anti").select("method", "stmt", "type").distinct()
    at = depths.groupBy("ep", F.col("node").alias("method")).agg(F.sort_array(F.collect_set("depth")).alias("depths"))
    return at.join(own, "method").select("ep", "method", "stmt", "type", "depths")


def on_paths(allowed: DataFrame, sinks: DataFrame) -> DataFrame:
    """(ep, node): nodes on some path from the entry point to a sink (forward closure met by the backward one)."""
    return reach_back(allowed, sinks).select("ep", "node").distinct()


def first_paths(edges: DataFrame, seeds: DataFrame, max_level: int | None = None, leaves_only: bool = False) -> DataFrame:
    """(ep, node, path): for each node the least, in array order, of the shortest paths from the entry point."""
    e = edges.select("src", "tgt").distinct()
    seen = cut(seeds.select("ep", "node", F.array("node").alias("path")), "paths")
    frontier, level = seen, 0
    while max_level is None or level < max_level:
        level += 1
        step = frontier.join(e, F.col("node") == F.col("src")).select("ep", F.col("tgt").alias("node"), F.concat("path", F.array("tgt")).alias("path"))
        step = step.join(seen, ["ep", "node"], "left_anti").groupBy("ep", "node").agg(F.min("path").alias("path"))
        frontier = cut(step, "paths")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if level % REACH_CUT == 0:
            seen = cut(seen, "paths")
    if leaves_only:
        seen = seen.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("ep", "node", "path")
    return seen


def subgraph_sizes(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(ep, n_nodes, n_edges) of each closure, without edges back to the entry point."""
    nodes = reached.groupBy("ep").agg(F.count("*").alias("n_nodes"))
    e = allowed_edges(edges, reached).where("tgt <> ep").groupBy("ep").agg(F.count("*").alias("n_edges"))
    return nodes.join(e, "ep", "left").select("ep", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))


def size_histogram(sizes: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bucket, lo, hi, n): equal buckets between the least and the largest value; the largest is in the last."""
    ends = sizes.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x = sizes.join(F.broadcast(ends), F.lit(True))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / buckets), F.lit(1))
    x = x.withColumn("bucket", F.floor((F.col(column) - F.col("lo")) / width))
    return x.groupBy("bucket").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n"))


def common_edges(allowed: DataFrame, eps: DataFrame) -> DataFrame:
    """(src, tgt): edges in the closure of every entry point of `eps`."""
    n = eps.select("ep").distinct().agg(F.count("*").alias("n"))
    shared = allowed.join(eps.select("ep"), "ep", "left_semi").groupBy("src", "tgt").agg(F.countDistinct("ep").alias("k"))
    return shared.join(F.broadcast(n), F.col("k") == F.col("n")).select("src", "tgt")


def common_components(edges: DataFrame) -> DataFrame:
    """(component, n_nodes, n_edges, starts): weakly connected parts of common edges and their nodes without in-edges."""
    edges = cut(edges.select("src", "tgt"), "common")
    c = components(edges.select(F.col("src").alias("a"), F.col("tgt").alias("b")))
    inner = edges.select(F.col("tgt").alias("id")).distinct().withColumn("inner", F.lit(1))
    nodes = c.join(inner, "id", "left").groupBy("component").agg(F.count("*").alias("n_nodes"), F.sort_array(F.collect_list(F.when(F.col("inner").isNull(), F.col("id")))).alias("starts"))
    count = edges.join(c, F.col("src") == F.col("id")).groupBy("component").agg(F.count("*").alias("n_edges"))
    return nodes.join(count, "component").select("component", "n_nodes", "n_edges", "starts")


def visit_counts(allowed: DataFrame, reached: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(node, visits, eps[, checks]): in-edges met over all closures and the entry points that reach each node."""
    visits = allowed.groupBy(F.col("tgt").alias("node")).agg(F.count("*").alias("visits"))
    eps = reached.groupBy("node").agg(F.countDistinct("ep").alias("eps"))
    out = eps.join(visits, "node", "left").withColumn("visits", F.coalesce("visits", F.lit(0)))
    return out if checks is None else out.join(checks, "node", "left")


def missing_eps(seen: DataFrame, group_size: int) -> DataFrame:
    return seen.withColumn("missing", F.lit(group_size) - F.col("eps"))


def depth_bucket(depth: Column, max_depth: Column, buckets: int = 4) -> Column:
    """The number, from 1, of the depth's bucket: the k-th ends at floor(max_depth * k / buckets). Less deep graphs have
    fewer buckets; a depth beyond max_depth is an error."""
    most = F.greatest(max_depth.cast("long"), F.lit(1))
    k = F.greatest(F.when(F.lit(buckets) > most, most - 1).otherwise(F.lit(buckets)), F.lit(1))
    own = F.greatest(F.ceil(depth * k / most), F.lit(1))
    return F.when(depth > most, F.raise_error(F.lit("a depth is beyond the largest"))).otherwise(own)


def skewed_average(depth: Column, value: Column, max_depth: Column, buckets: int = 4) -> Column:
    """Aggregate: average of `value` weighted by 1 / (number of its depth bucket), rounded half up to a whole number."""
    bucket = depth_bucket(depth, max_depth, buckets)
    return F.floor(F.sum(value / bucket) / F.sum(F.lit(1) / bucket) + 0.5).cast("int")


def whole_average(total: Column, count: Column) -> Column:
    """total / count without the fraction; 0 of none."""
    return F.when(count > 0, F.floor(total / count)).otherwise(0).cast("long")


def ambiguous_dispatch(edges: DataFrame) -> DataFrame:
    """(src, subsig, n_targets) of callers that have several targets for one sub-signature. edges: src, subsig, tgt."""
    return edges.groupBy("src", "subsig").agg(F.countDistinct("tgt").alias("n_targets")).where("n_targets > 1")


def class_graph(edges: DataFrame, classes: DataFrame, cap: int = 7) -> DataFrame:
    """(src_class, tgt_class, weight): edges between classes, weighted by multiplicity up to `cap`. classes: node, class."""
    s, t = (classes.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class")) for c in ("src", "tgt"))
    return edges.join(s, "src").join(t, "tgt").groupBy("src_class", "tgt_class").agg(F.least(F.count("*"), F.lit(cap)).alias("weight"))


def sink_overview(allowed: DataFrame, sinks: DataFrame) -> DataFrame:
    """(ep, sink, n_nodes, n_edges): what lies on the way from each entry point to each sink it reaches."""
    back = reach_back(allowed, sinks)
    inside = allowed.join(back.select("ep", "sink", F.col("node").alias("tgt")), ["ep", "tgt"]).groupBy("ep", "sink").agg(F.count("*").alias("n_edges"))
    return back.groupBy("ep", "sink").agg(F.count("*").alias("n_nodes")).join(inside, ["ep", "sink"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def subclasses(parents: DataFrame) -> DataFrame:
    """(sub, super): the transitive closure of direct (sub, super) rows, classes themselves included."""
    nodes = parents.select("sub").union(parents.select("super")).distinct()
    up = reach(parents.select(F.col("sub").alias("src"), F.col("super").alias("tgt")), nodes.select(F.col("sub").alias("ep"), F.col("sub").alias("node")))
    return up.select(F.col("ep").alias("sub"), F.col("node").alias("super"), F.col("level").alias("distance"))


def dispatch(calls: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """(call, target): class-hierarchy targets of virtual calls (call, class, subsig): for every subclass of the
    receiver's class the nearest definition at or above it. methods: method, class, subsig."""
    up = subclasses(parents)
    cand = calls.join(up.select("sub", F.col("super").alias("class")), "class").select("call", "subsig", F.col("sub").alias("receiver"))
    found = cand.join(up.select(F.col("sub").alias("receiver"), F.col("super").alias("class"), "distance"), "receiver").join(methods, ["class", "subsig"])
    return found.groupBy("call", "receiver").agg(F.min(F.struct("distance", "method")).alias("m")).select("call", F.col("m.method").alias("target")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node on a cycle the largest node of its strongly connected component.

    Nodes that no cycle can hold are peeled off first. Then the largest id spreads along the edges; nodes of one colour
    from which the colour's own node is reached are its component, and go. Repeated on the rest, level by level.
    """
    e = cut(edges.select("src", "tgt").where("src is not null and tgt is not null").distinct(), "scc")
    found = cut(e.where("src = tgt").select(F.col("src").alias("node"), F.col("src").alias("component")), "scc")
    loops = found
    e = cut(e.where("src <> tgt"), "scc")
    parts = []
    while True:
        before = -1
        while (n := e.count()) != before:
            before = n
            e = cut(e.join(e.select(F.col("tgt").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("tgt")).distinct(), "tgt", "left_semi").select("src", "tgt"), "scc")
        if not before:
            break
        color = cut(e.select(F.col("src").alias("node")).distinct().withColumn("color", F.col("node")), "scc")
        total, last = F.sum(F.xxhash64("node", "color").cast("decimal(38,0)")), None
        while (now := color.agg(total.alias("t")).first().t) != last:
            last = now
            spread = color.join(e, color["node"] == e["src"]).select(F.col("tgt").alias("node"), "color")
            color = cut(color.unionByName(spread).groupBy("node").agg(F.max("color").alias("color")), "scc")
        same = e.join(color.select(F.col("node").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("node").alias("tgt"), F.col("color").alias("ct")), "tgt").where("cs = ct")
        back = cut(same.select(F.col("tgt").alias("at"), F.col("src").alias("node"), F.col("cs").alias("color")), "scc")
        own = cut(color.where("node = color"), "scc")
        frontier = own
        while True:
            step = frontier.select(F.col("node").alias("at")).join(back, "at").select("node", "color").distinct()
            frontier = cut(step.join(own, ["node", "color"], "left_anti"), "scc")
            if frontier.isEmpty():
                break
            own = own.unionByName(frontier)
        own = cut(own.select("node", F.col("color").alias("component")), "scc")
        several = own.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
        parts.append(own.join(several, "component", "left_semi").select("node", "component"))
        gone = own.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "tgt"), "tgt", "left_anti").select("src", "tgt"), "scc")
    for p in parts:
        found = found.unionByName(p)
    return found.groupBy("node").agg(F.max("component").alias("component")) if parts else loops


def visits_by_ep(allowed: DataFrame, reached: DataFrame) -> DataFrame:
    """(ep, node, visits, depths): how often edges of the closure meet each node, and at which depths."""
    at = allowed.join(reached.select("ep", F.col("node").alias("src"), F.col("level").alias("from")), ["ep", "src"])
    met = at.groupBy("ep", F.col("tgt").alias("node")).agg(F.count("*").alias("visits"), F.collect_set(F.col("from") + 1).alias("d"))
    out = reached.join(met, ["ep", "node"], "left")
    return out.select("ep", "node", F.coalesce("visits", F.lit(0)).cast("long").alias("visits"), F.sort_array(F.array_union(F.array("level"), F.coalesce("d", F.array().cast("array<int>")))).alias("depths"))


def edited_call_graph(edges: DataFrame, excluded: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges without class initialisers and excluded callers, led from proxies to entry points; and (step, n): how many
    edges each step left."""
    init = lambda c: F.contains(F.col(c), F.lit("<clinit>"))
    one = cut(edges.select("src", "tgt").distinct(), "edit")
    two = cut(one.where(~init("src") & ~init("tgt")), "edit")
    three = cut(two.join(excluded.select(F.col("node").alias("src")).distinct(), "src", "left_anti").select("src", "tgt"), "edit")
    four = cut(three.join(targets, three["tgt"] == targets["method"], "left").select("src", F.coalesce("ep", "tgt").alias("tgt")).distinct(), "edit")
    steps = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), "n") for k, df in (("all", one), ("initialisers", two), ("excluded", three), ("rewritten", four))]
    return four, union_all(steps)


def logic_graph(allowed: DataFrame, sources: DataFrame, queries: DataFrame, cap: int = 7) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, color) and edges (src, tgt, weight) of what leads to sources and context queries (node) inside the entry
    points' closures: an edge weighs one more for each further entry point, up to `cap`."""
    sinks = sources.select(F.col("node").alias("sink")).union(queries.select("node")).distinct()
    on = reach_back(allowed, sinks).select("ep", "node").distinct()
    e = allowed.join(on.withColumnRenamed("node", "src"), ["ep", "src"], "left_semi").join(on.withColumnRenamed("node", "tgt"), ["ep", "tgt"], "left_semi")
    e = cut(e.groupBy("src", "tgt").agg(F.least(F.count("*"), F.lit(cap)).alias("weight")), "logic")
    mark = lambda df, c: df.select(F.col("node").alias("id"), F.lit(True).alias(c)).distinct()
    eps = allowed.select(F.col("ep").alias("node"))
    n = e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct().join(mark(eps, "ep"), "id", "left").join(mark(queries, "query"), "id", "left").join(mark(sources, "source"), "id", "left")
    return n.select("id", F.when(F.col("ep"), "green").when(F.col("query"), "red").when(F.col("source"), "blue").otherwise("white").alias("color")), e


def query_subgraphs(edges: DataFrame, queries: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(ep, cq, method): methods that each entry point's context queries (ep, cq) reach."""
    pair = F.struct("ep", "cq")
    r = reach(edges, queries.select(pair.alias("ep"), F.col("cq").alias("node")), excluded)
    return r.select(F.col("ep.ep").alias("ep"), F.col("ep.cq").alias("cq"), F.col("node").alias("method"))


def forward_predicates(uses: DataFrame, seeds: DataFrame, branches: DataFrame) -> DataFrame:
    """(seed, unit): branch statements reached from seeds by def -> use. uses: def, use; seeds: unit; branches: unit."""
    r = reach(uses.select(F.col("def").alias("src"), F.col("use").alias("tgt")), seeds.select(F.col("unit").alias("ep"), F.col("unit").alias("node")))
    return r.select(F.col("ep").alias("seed"), F.col("node").alias("unit")).join(branches.select("unit"), "unit", "left_semi").select("seed", "unit")


def _state(c: str, up: int) -> Column:
    return F.concat(F.col(c).cast("string"), F.lit(f"|{up}"))


def _unit(c: str) -> Column:
    return F.regexp_replace(c, r"\|[01]$", "").alias("unit")


def _backward_edges(units: DataFrame, callers: DataFrame, depends: DataFrame, defs: DataFrame, exits: DataFrame, inner: DataFrame) -> DataFrame:
    """(src, tgt) between states: a unit and whether it lies on the way up."""
    up = units.join(callers, "method").select(_state("unit", 1).alias("src"), _state("call", 1).alias("tgt"))
    side = depends.select("unit", "on").union(defs.select("unit", "on"))
    into = exits.select("call", "unit").union(inner.select("call", "unit"))
    return union_all([up, side.select(_state("unit", 1).alias("src"), _state("on", 0).alias("tgt")), side.select(_state("unit", 0).alias("src"), _state("on", 0).alias("tgt")), into.select(_state("call", 0).alias("src"), _state("unit", 0).alias("tgt"))])


def backward_predicates(units: DataFrame, seeds: DataFrame, callers: DataFrame, depends: DataFrame, defs: DataFrame, exits: DataFrame, inner: DataFrame, branches: DataFrame) -> DataFrame:
    """(seed, unit): branches that decide whether a seed runs, or on what it depends: the closure over callers on the way
    to the entry point, iterated control dependences, definitions of used locals, and exits of callees and the calls in them.

    units: unit, method; callers: method, call; depends, defs: unit, on; exits: call, unit (ends of a called method); inner:
    call, unit (calls within it). A state is a unit and whether it lies on the way up; only such states go to callers, and
    only others enter the calls.
    """
    edges = _backward_edges(units, callers, depends, defs, exits, inner)
    r = reach(edges, seeds.select(F.col("unit").alias("ep"), _state("unit", 1).alias("node")))
    found = r.select(F.col("ep").alias("seed"), _unit("node")).distinct()
    return found.join(branches.select(F.col("unit").cast("string").alias("unit")).distinct(), "unit", "left_semi").select("seed", "unit")


def backward_counts(units: DataFrame, seeds: DataFrame, callers: DataFrame, depends: DataFrame, defs: DataFrame, exits: DataFrame, inner: DataFrame, branches: DataFrame) -> DataFrame:
    """(seed, n, least, most): how many branches `backward_predicates` finds for each seed that has any, and the ends of their
    order, without a row for each of them. Seeds share what they lead to: the closure is made once for each of the states that
    come next, and `union_counts` counts what these hold together."""
    edges = bucketed(_backward_edges(units, callers, depends, defs, exits, inner), "src", label="edges")
    seeds = seeds.select(F.col("unit").alias("seed")).distinct()
    lists = cut(seeds.join(edges, _state("seed", 1) == F.col("src")).groupBy("seed").agg(F.sort_array(F.collect_set("tgt")).alias("parts")), "next")
    parts = lists.select(F.explode("parts").alias("part")).distinct()
    r = reach(edges, parts.select(F.col("part").alias("ep"), F.col("part").alias("node")), table=True)
    # the units as the branches have them, so that they keep their order
    named = branches.select("unit", F.col("unit").cast("string").alias("_unit")).distinct()
    sets = cut(r.select(F.col("ep").alias("part"), _unit("node").alias("_unit")).join(named, "_unit").select("part", "unit").distinct(), "sets")
    # a seed counts as well, but once
    own = cut(seeds.join(named, F.col("seed").cast("string") == F.col("_unit")).select("seed", "unit"), "own")
    back = cut(sets.join(own.select("unit"), "unit", "left_semi"), "back")
    again = lists.join(own, "seed").select("seed", "unit", F.explode("parts").alias("part")).join(back, ["part", "unit"], "left_semi").select("seed")
    own = own.join(again, "seed", "left_anti").select("seed", F.lit(1).cast("long").alias("n"), F.col("unit").alias("least"), F.col("unit").alias("most"))
    return union_counts(lists, sets).unionByName(own).groupBy("seed").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def union_counts(lists: DataFrame, sets: DataFrame, hub: int = 64, wide: int = 64) -> DataFrame:
    """(seed, n, least, most): how many different units the parts of each seed hold together, and the ends of their order; seeds
    whose parts hold none are left out. lists: seed, parts (an array without repeats); sets: part, unit, once each.

    The sizes of the parts are added up, less what a part shares with one before it. What is shared is found by pairs of parts,
    for units that at most `hub` parts hold; the others are few for their number of rows, and are bits of words, merged by
    `bit_or`. Seeds of more than `wide` parts do not make pairs: their units are counted themselves. So rows grow with the sets
    and the seeds' parts, not with the units of all seeds."""
    held = sets.groupBy("unit").agg(F.count("*").alias("m")).where("m > 1")
    shared = cut(sets.join(held, "unit"), "held")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = cut(held.where(F.col("m") > hub).select("unit").repartitionByRange(n, "unit").sortWithinPartitions("unit").withColumn("id", F.monotonically_increasing_id()), "hubs")
    bits = shared.join(hubs, "unit").groupBy("part", F.shiftright("id", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS int))")).alias("bits")).groupBy("part").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    light = sets.join(hubs.select("unit"), "unit", "left_anti").groupBy("part").agg(F.count("*").alias("k"))
    ends = sets.groupBy("part").agg(F.min("unit").alias("least"), F.max("unit").alias("most"))
    of = cut(ends.join(light, "part", "left").join(bits, "part", "left"), "parts")
    # a part's own row has no word
    none = F.lit(None).cast("long")
    row = F.struct(none.alias("word"), none.alias("bits"), F.coalesce("k", F.lit(0).cast("long")).alias("k"), "least", "most")
    word = lambda w: F.struct(w["word"].alias("word"), w["bits"].alias("bits"), F.lit(0).cast("long").alias("k"), F.col("least"), F.col("most"))
    each = F.concat(F.array(row), F.coalesce(F.transform("words", word), F.slice(F.array(row), 1, 0)))
    rows = lists.select("seed", F.explode("parts").alias("part")).join(of, "part").select("seed", F.explode(each).alias("x")).select("seed", "x.*")
    total = rows.groupBy("seed", "word").agg(F.sum("k").alias("k"), F.bit_or("bits").alias("bits"), F.min("least").alias("least"), F.max("most").alias("most"))
    total = total.groupBy("seed").agg(F.sum(F.col("k") + F.coalesce(F.bit_count("bits"), F.lit(0))).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    some = cut(shared.where(F.col("m") <= hub).select("part", "unit"), "shared")
    before = some.withColumnRenamed("part", "a").join(some.withColumnRenamed("part", "b"), "unit").where("a < b").groupBy("a", "b").agg(F.collect_list("unit").alias("units"))
    pairs = F.flatten(F.transform("parts", lambda b, i: F.transform(F.slice("parts", 1, i), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    met = lists.where(F.size("parts") <= wide).select("seed", F.explode(pairs).alias("p")).select("seed", "p.*").join(before, ["a", "b"]).select("seed", "b", "units")
    twice = met.repartition(n, "seed").groupBy("seed", "b").agg(F.size(F.array_distinct(F.flatten(F.collect_list("units")))).alias("k")).groupBy("seed").agg(F.sum("k").alias("twice"))
    many = lists.where(F.size("parts") > wide).select("seed", F.explode("parts").alias("part")).join(some, "part").groupBy("seed", "unit").agg((F.count("*") - 1).alias("k")).groupBy("seed").agg(F.sum("k").alias("twice"))
    return total.join(twice.unionByName(many), "seed", "left").select("seed", (F.col("n") - F.coalesce("twice", F.lit(0))).alias("n"), "least", "most")


def parameter_definitions(params: DataFrame, args: DataFrame) -> DataFrame:
    """(use, def): a method's parameter is defined by the argument of each of its calls. params: node, method, pos; args:
    callee, pos, def."""
    return params.join(args, (params["method"] == args["callee"]) & (params["pos"] == args["pos"])).select(F.col("node").alias("use"), "def").distinct()


def def_use_graph(seeds: DataFrame, local: DataFrame, params: DataFrame, args: DataFrame) -> DataFrame:
    """(use, def): definitions that the seeds (node) need, within methods and over parameters."""
    every = local.select("use", "def").union(parameter_definitions(params, args)).distinct()
    r = reach(every.select(F.col("use").alias("src"), F.col("def").alias("tgt")), seeds.select(F.lit(0).alias("ep"), "node")).select(F.col("node").alias("use"))
    return every.join(r, "use", "left_semi").select("use", "def")


def without_receivers(graph: DataFrame, seeds: DataFrame, receivers: DataFrame) -> DataFrame:
    """The graph (use, def) without what only receivers (use, def) bring in: their edges go, the rest is closed anew."""
    left = graph.join(receivers.select("use", "def"), ["use", "def"], "left_anti")
    r = reach(left.select(F.col("use").alias("src"), F.col("def").alias("tgt")), seeds.select(F.lit(0).alias("ep"), "node")).select(F.col("node").alias("use"))
    return left.join(r, "use", "left_semi").select("use", "def")


def gathered_values(used: DataFrame) -> DataFrame:
    """The same as `gathered` from rows (ep, start, kind, value), each there once."""
    return used.groupBy("kind", "value").agg(F.countDistinct("ep").alias("n_eps"), F.count("*").alias("n_starts"))


def gathered(used: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, value, n_eps, n_starts): fields, methods and strings that starts use. used: ep, start, node; nodes: ep, node,
    kind, value."""
    return used.join(nodes, ["ep", "node"]).groupBy("kind", "value").agg(F.countDistinct("ep").alias("n_eps"), F.countDistinct("ep", "start").alias("n_starts"))


def entry_points(parents: DataFrame, root: str, methods: DataFrame, blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """(stub, ep, tx_ids): what the transaction methods of the subclasses of `root` call in each transaction's block.
    methods: class, method (their transaction methods); blocks: method, tx, stmt; calls: method, stmt, target."""
    stubs = subclasses(parents).where((F.col("super") == root) & (F.col("sub") != root)).select(F.col("sub").alias("class"))
    own = methods.join(stubs, "class", "left_semi")
    hit = own.join(blocks, "method").join(calls, ["method", "stmt"])
    return hit.groupBy(F.col("class").alias("stub"), F.col("target").alias("ep")).agg(F.sort_array(F.collect_set("tx")).alias("tx_ids"))


def transaction_blocks(flow: DataFrame, cases: DataFrame, ends: DataFrame) -> DataFrame:
    """(method, tx, stmt): statements that a transaction's first one reaches before the branches join. flow: method, src,
    tgt; cases: method, tx, stmt; ends: method, stmt (where the branches join)."""
    key = F.struct("method", "tx")
    at = lambda c: F.struct("method", F.col(c).alias("stmt"))
    r = reach(flow.select(at("src").alias("src"), at("tgt").alias("tgt")), cases.select(key.alias("ep"), at("stmt").alias("node")), ends.select(at("stmt").alias("node")), mode="drop")
    return r.select(F.col("ep.method").alias("method"), F.col("ep.tx").alias("tx"), F.col("node.stmt").alias("stmt"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
