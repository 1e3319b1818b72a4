"""What grew too fast on larger tables. Each test fails on the code before its finding."""

from collections import Counter

from pyspark.sql import functions as F


def rows(df):
    return Counter(map(tuple, df.collect()))


def counted(spark, df):
    """`df`, and how many of its rows have been made so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_closures_make_their_edges_once(spark):
    """the edges of a closure of many levels are made once, not once a level."""
    from checkloom.operators import graph, incremental

    edges, seen = counted(spark, spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 4), (20, 21)], "src long, tgt long"))
    seeds = spark.createDataFrame([(0, 0), (9, 9)], "ep long, node long")
    before = graph.reach(edges, seeds)
    assert rows(before) == Counter([(0, i, i) for i in range(13)] + [(9, i, i - 9) for i in range(9, 13)]) and seen.value == 14
    edges, seen = counted(spark, edges)
    pairs = lambda *p: spark.createDataFrame(list(p), "src long, tgt long")
    got = incremental.kept_closure(before, edges, pairs((2, 20), (0, 1)), pairs((5, 6)), seeds)
    assert rows(got) == Counter([(0, i) for i in range(6)] + [(0, 20), (0, 21)] + [(9, i) for i in range(9, 13)]) and seen.value == 14


def test_facts_are_made_once(spark, tmp_path, monkeypatch):
    """The edges of the def-use facts are one table in buckets, not made anew for each join."""
    from checkloom.plans import catalogue_facts as C

    lines = [(o, n, o * n % 7, o + n) for o in range(8) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(8).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    plan = C._facts(spark, str(tmp_path))[2].join(spark.range(9).select(F.col("id").alias("def"), F.lit("1").alias("ep")), ["ep", "def"])
    assert "Aggregate" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_values_go_up(spark):
    """values of what starts use, without the pairs of starts and nodes."""
    from checkloom.operators import graph, restrictions

    edges = spark.createDataFrame([("a", 1, 10), ("a", 10, 20), ("a", 10, 21), ("a", 2, 21), ("a", 21, 2), ("b", 1, 30)], "ep string, use long, def long")
    nodes = spark.createDataFrame([("a", 20, "field", "x"), ("a", 21, "field", "x"), ("b", 30, "field", None), ("a", 2, "field", "y"), ("b", 21, "field", "z")], "ep string, node long, kind string, value string")
    starts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "ep string, start long")
    got = restrictions.used_values(starts, edges, nodes)
    assert rows(graph.gathered_values(got)) == rows(graph.gathered(restrictions.used_nodes(starts, edges), nodes)) == Counter([("field", "x", 1, 2), ("field", "y", 1, 2), ("field", None, 1, 1)])


def test_shared_types_go_up(spark, monkeypatch):
    """what made objects share goes up the assignments, circles too, without the pairs of sites and objects."""
    from checkloom.operators import joins

    def pairs(*_):
        raise AssertionError("pairs of sites and objects are made")

    monkeypatch.setattr(joins, "least_types", pairs)
    frame = lambda schema, *r: spark.createDataFrame(list(r), ", ".join(f"{c} string" for c in schema.split()))
    parents = frame("sub super", ("A", "I"), ("A", "J"), ("B", "I"), ("B", "J"), ("C", "J"), ("I", "O"), ("J", "O"))
    links = frame("use def", ("x", "y"), ("y", "x"), ("y", "a"), ("x", "b"), ("z", "c"), ("z", "x"), ("z", "empty"), ("w", "empty"), ("v", "lone"))
    sites = frame("service node", ("sx", "x"), ("sz", "z"), ("sw", "w"), ("sv", "v"), ("sa", "a"), ("both", "a"), ("both", "c"), ("both", "w"), ("gone", "lone"), ("gone", "a"))
    types = frame("node type", ("a", "A"), ("b", "B"), ("c", "C"), ("lone", "X"))
    got = joins.inferred_services(sites, links, types, parents, frame("binder stub", ("J", "stub")))
    assert rows(got) == Counter([("sx", "I", None), ("sx", "J", "stub"), ("sz", "J", "stub"), ("sw", None, None), ("sv", "X", None), ("sa", "A", None), ("both", "J", "stub"), ("gone", None, None)])


def test_hot_keys_are_dealt(spark):
    """a key's product is dealt over many groups, and holds each pair once."""
    from checkloom.operators import joins

    left, right = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("a")), spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("b"))
    got = joins.spread_join(left, right, ["k"], pairs=100)
    assert rows(got) == Counter((a % 2, a, b) for a in range(300) for b in range(a % 2, 50, 2))
    proxies = spark.createDataFrame([("i", 1, 1), ("i", 2, 9), ("i", 3, None), ("i", 4, 1), ("j", 4, 1), ("j", 5, 1), ("i", 1, 1)], "iface string, method long, tx long")
    stubs = spark.createDataFrame([("i", "e", 1), ("i", "e", 1), ("i", "d", None), ("j", "e", 1), ("j", "f", 1)], "iface string, ep string, tx long")
    assert rows(joins.binder_join(proxies, stubs)) == Counter([(1, "e"), (2, "d"), (3, "d"), (4, "e"), (4, "f"), (5, "e"), (5, "f")])


def test_common_edges_are_made_once(spark):
    """components of common edges make these once."""
    from checkloom.operators import graph

    edges, seen = counted(spark, spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, tgt long"))
    assert {(r.component, r.n_nodes, r.n_edges, tuple(r.starts)) for r in graph.common_components(edges).collect()} == {(1, 3, 2, (1,)), (7, 2, 1, (7,))} and seen.value == 3


def test_methods_are_rows(spark):
    """a method's definitions, aliases and uses meet in one row, without groups in Python and without a closure over all."""
    from checkloom.operators import locals as L

    flow = spark.createDataFrame([("m", 1, 2), ("m", 2, 3), ("m", 3, 4), ("m", 4, 2), ("m", 4, None), ("k", 1, 2)], "method string, src long, tgt long")
    defs = spark.createDataFrame([("m", 1, "a", "value", None), ("m", 2, "b", "local", "a"), ("m", 3, "a", "array", "b"), ("k", 1, "a", "cast", "b")], "method string, stmt long, local string, kind string, source string")
    uses = spark.createDataFrame([("m", 4, "a"), ("m", 4, "b"), ("m", 3, "b"), ("m", 2, "a"), ("k", 2, "a"), ("k", 2, "z"), ("none", 1, "a")], "method string, stmt long, local string")
    got = L.local_uses(flow, defs, uses, arrays=True, remove=("array",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    assert rows(got) == Counter([("m", 3, 4, "a"), ("m", 2, 4, "a"), ("m", 1, 4, "a"), ("m", 2, 4, "b"), ("m", 1, 4, "b"), ("m", 3, 4, "b"), ("m", 1, 2, "a"), ("m", 3, 2, "a"), ("m", 2, 2, "a"), ("k", 1, 2, "a")])


def test_backward_counts_make_no_pairs(spark, monkeypatch):
    """F8: what seeds lead to is counted without a row for each seed and branch; hubs, seeds of many parts and circles too."""
    import random

    from checkloom.operators import graph

    rng = random.Random(8)
    pick = lambda n: [(rng.randrange(60), rng.randrange(60)) for _ in range(n)]
    frame = lambda names, data: spark.createDataFrame(data, ", ".join(f"{c} long" for c in names.split()))
    units = frame("unit method", [(i, i % 7) for i in range(60)])
    parts = (units, units.where("unit % 3 > 0").select("unit"), frame("method call", [(i % 7, rng.randrange(60)) for i in range(10)]), frame("unit on", pick(40)), frame("unit on", pick(30)), frame("call unit", pick(15)), frame("call unit", pick(15)), frame("unit", [(i,) for i in range(60) if i % 4]))
    found = graph.backward_predicates(*parts).collect()
    want = {}
    for r in found:
        want.setdefault(r.seed, []).append(int(r.unit))
    want = Counter((k, len(v), min(v), max(v)) for k, v in want.items())
    plain = graph.union_counts
    for hub, wide in ((64, 64), (2, 2)):
        monkeypatch.setattr(graph, "union_counts", lambda lists, sets, hub=hub, wide=wide: plain(lists, sets, hub, wide))
        assert rows(graph.backward_counts(*parts)) == want
    assert len(want) > 20


def test_sizes_make_the_closures_once(spark):
    """the closures' edges are made once, and steps over them go by whole numbers."""
    from checkloom.operators import order

    allowed, seen = counted(spark, spark.createDataFrame([("r", "r", "a"), ("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c"), ("r", "c", "r"), ("q", "q", "c"), ("q", "c", "c")], "ep string, src string, tgt string"))
    assert rows(order.descendant_sizes(allowed)) == Counter([("r", "r", 4, 4), ("r", "a", 3, 3), ("r", "b", 3, 3), ("r", "c", 1, 0), ("q", "q", 2, 2), ("q", "c", 1, 1)])
    assert seen.value == 7


def test_phrases_are_walked_by_batches(spark):
    """names are not walked word by word in an interpreted expression; names and words may be null, names empty."""
    from checkloom.functions import phrases

    own = phrases.Phrases(["^get * id$", "user", "b a"])
    names = spark.createDataFrame([(0, ["get", "user", "id"]), (1, None), (2, []), (3, ["b", "a"]), (4, [None]), (5, ["get", "id", "x"]), (6, ["b", None, "a"])], "k long, words array<string>").repartition(1)
    got = names.withColumn("bits", own.bits(F.col("words"))).select("k", *[own.hit(F.col("bits"), p) for p in own.place])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    no = (False, False, False)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {0: (True, True, False), 1: (None, None, None), 2: no, 3: (False, False, True), 4: no, 5: no, 6: no}


def test_calls_are_not_told_apart(spark, tmp_path):
    """Calls and edges, a row for each line, are not sorted or aggregated as facts; lines that repeat change nothing."""
    from checkloom.plans import catalogue_facts as C

    lines = [(o, n, o * n % 7, o + n) for o in range(8) for n in (1, 2)] * 2
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(9).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    plan = C._facts(spark, str(tmp_path))[1].where("kind = 'invoke'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert rows(C.keep_declaring_class(spark, str(tmp_path))) == Counter((str(o % 3), o) for o in range(8))


def test_nested_products_are_not_written(spark, monkeypatch):
    """what callers get of a large set is neither written nor shuffled; texts that meet, stay open or spell parameters too."""
    import random
    import re

    from checkloom.operators import joins

    written = []
    plain = joins.cut

    def cut(df, label="cut"):
        df = plain(df, label)
        written.append(df.count())
        return df

    monkeypatch.setattr(joins, "cut", cut)
    schema = "ep string, op1 string, op2 string, called string, root boolean"
    checks = [("n", f"$1.$0 + {i}", "n", None, False) for i in range(60)] + [(f"c{i}", "call", "n", "n", i % 2 == 0) for i in range(20)] + [(f"o{i}", "call", None, f"c{i % 20}", True) for i in range(100)]
    args = [(f"c{i}", "n", [str(i), "$0"]) for i in range(20)] + [(f"o{i}", f"c{i % 20}", [f"k{i}"]) for i in range(100)]
    got = joins.substitute_nested(spark.createDataFrame(checks, schema), spark.createDataFrame(args, "ep string, called string, values array<string>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert max(written) < 500 and "Aggregate" not in plan  # 100 callers of 60 checks
    want = [("n", f"$1.$0 + {i}", "n") for i in range(60)] + [(f"c{c}", f"$0.{c} + {i}", "n") for c in range(20) for i in range(60)] + [(f"o{o}", f"k{o}.{o % 20} + {i}", "n") for o in range(100) for i in range(60)]
    assert rows(got) == Counter(want + [(f"c{c}", "call", "n") for c in range(1, 20, 2)] + [(f"o{o}", "call", "n") for o in range(1, 100, 2)])

    def bound(text, values):
        return text and re.sub(r"\$\d+", lambda m: next((v for v in [values[int(m[0][1:])]] if v is not None), m[0]) if int(m[0][1:]) < len(values) else m[0], text)

    rng = random.Random(13)
    pieces = ["$0", "$1", "$2", "a", "b", "1", "$", " + ", "$10", ""]
    text = lambda k=3: "".join(rng.choice(pieces) for _ in range(rng.randint(0, k)))
    checks, args = [], []
    for level in range(5):
        for i in range(14):
            ep, n = f"e{level}.{i}", rng.choice([0, 1, 2, 20])
            checks += [(ep, text(), text() if rng.random() < 0.7 else None, None, False) for _ in range(n if level else rng.choice([1, 6, 30]))]
            for _ in range(rng.choice([1, 1, 1, 2]) if level else 0):
                called, root = f"e{rng.randrange(level)}.{rng.randrange(14)}", rng.random() < 0.5
                checks.append((ep, f"call {called}", None, called, root))
                args += [(ep, called, rng.choice([None, [], [text()], [text(), None, text(2)], ["1", "$0"]])) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    there, done = {c[0] for c in checks}, {}
    for ep in sorted(there):  # levels in order, as their names are
        done[ep] = set()
        for e, a, b, called, root in checks:
            if e == ep:
                given = [v or [] for x, y, v in args if (x, y) == (ep, called)] if called in there else []
                done[ep] |= {(bound(x, v), bound(y, v)) for v in given for x, y in done[called]} | (set() if given and root else {(a, b)})
    got = joins.substitute_nested(spark.createDataFrame(checks, schema), spark.createDataFrame(args, "ep string, called string, values array<string>"))
    assert rows(got) == Counter((ep, *x) for ep, found in done.items() for x in found)


def test_entry_point_products_are_not_told_apart(spark, monkeypatch):
    """what callers get of a called entry point's checks is neither shuffled nor written, by broadcast and by dealt joins; texts
    that meet, null texts and values, own rows that a product holds, several calls, many own rows, three parameters."""
    import random
    import re

    from checkloom.operators import joins

    schema, given = "ep string, op1 string, op2 string, called string, root boolean", "ep string, called string, values array<string>"
    checks = [("n", f"$0 + {i}", "x", None, False) for i in range(60)] + [(f"c{i}", "call", None, "n", i % 2 == 0) for i in range(50)]
    got = joins.substitute_entry_points(spark.createDataFrame(checks, schema), spark.createDataFrame([(f"c{i}", "n", [str(i)]) for i in range(50)], given))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # only what is written out goes through an aggregate, which is below the union
    assert plan.startswith("Union") and "Aggregate" not in plan[plan.rindex("explode("):]
    assert rows(got) == Counter([(e, a, b) for e, a, b, _, root in checks if not root] + [(f"c{c}", f"{c} + {i}", "x") for c in range(50) for i in range(60)])

    def bound(text, values):
        values = values or []
        return text and re.sub(r"\$\d+", lambda m: next((v for v in [values[int(m[0][1:])]] if v is not None), m[0]) if int(m[0][1:]) < len(values) else m[0], text)

    rng = random.Random(4)
    pieces = ["$0", "$1", "$2", "a", "b", "1", "$", " + ", ""]
    text = lambda k=4: "".join(rng.choice(pieces) for _ in range(rng.randint(0, k)))
    for held in (joins.HELD, 0):
        monkeypatch.setattr(joins, "HELD", held)
        checks, args = [], []
        for i in range(40):
            ep = f"e{i}"
            checks += [(ep, text() if rng.random() < 0.9 else None, text(2) if rng.random() < 0.7 else None, None, False) for _ in range(rng.choice([0, 1, 3, 25]))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                called = f"e{rng.randrange(45)}"
                checks.append((ep, f"call {called}", None, called, rng.random() < 0.5))
                args += [(ep, called, rng.choice([None, [], [text()], [text(), None], ["1", "a", "b"]])) for _ in range(rng.choice([0, 1, 1, 2]))]
        want = {(e, a, b) for e, a, b, called, root in checks if called is None or not root}
        want |= {(e, bound(a, v), bound(b, v)) for e, _, _, c, _ in checks if c for x, y, v in args if (x, y) == (e, c) for f, a, b, _, _ in checks if f == c}
        got = joins.substitute_entry_points(spark.createDataFrame(checks, schema), spark.createDataFrame(args, given))
        assert rows(got) == Counter(want)


def test_dense_closure_by_tiles(spark, monkeypatch):
    """a level of a dense graph makes no row for each node, edge or word; over blocks, groups and seeds of any kind."""
    import random

    from checkloom.operators import graph

    written = []
    plain = graph.cut

    def cut(df, label="cut"):
        df = plain(df, label)
        written.append((label, df.count()))
        return df

    def searched(edges, seeds, depth):
        out, found = {}, {}
        for a, b in rows(edges.dropna()):
            out.setdefault(a, set()).add(b)
        for e, x in rows(seeds):
            found.setdefault(e, {})[x] = 0
        for e, levels in found.items():
            for k in range(depth):
                new = {t for x, at in levels.items() if at == k for t in out.get(x, ())} - set(levels)
                levels |= dict.fromkeys(new, k + 1)
                if not new:
                    break
        return Counter((e, x, k) for e, levels in found.items() for x, k in levels.items())

    monkeypatch.setattr(graph, "cut", cut)
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(6000)], "src long, tgt long")
    seeds = spark.createDataFrame([(i, i) for i in range(300)], "ep long, node long")
    assert rows(graph.reach_dense(edges, seeds, max_level=5)) == searched(edges, seeds, 5)
    # the edges, 300 nodes and 300 entry points, then tiles
    assert sum(n for _, n in written) < 6000 + 300 + 300 + 60
    monkeypatch.setattr(graph, "BLOCK", 32)
    monkeypatch.setattr(graph, "WORDS", 1)
    monkeypatch.setattr(graph, "HELD_BLOCKS", 2)
    edges = spark.createDataFrame([(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(260)] + [(None, "n1"), ("n2", None)], "src string, tgt string")
    seeds = spark.createDataFrame([(f"e{rng.randrange(90)}", f"n{rng.randrange(170)}") for _ in range(160)], "ep string, node string")
    for depth in (None, 3):
        assert rows(graph.reach_dense(edges, seeds, max_level=depth)) == searched(edges, seeds, depth or 1000)


def test_values_are_made_once(spark):
    """F8: rows of value sets are made once, whether sets hold ALL or NULL or not."""
    from checkloom.functions.values import ALL, NULL
    from checkloom.operators import values

    plain = [("a", "x"), ("a", "x"), ("a", "1"), ("b", "2"), ("e", None), ("e", "y")]
    odd = [("c", ALL), ("c", "7"), ("d", ALL), ("d", "z"), ("d", NULL), ("f", NULL), ("g", ALL), ("g", NULL)]
    want = [("a", "x"), ("a", "1"), ("b", "2"), ("e", "y")]
    for data, more in ((plain, []), (plain + odd, [("c", ALL), ("d", ALL), ("d", "z"), ("f", NULL), ("g", ALL)])):
        df, seen = counted(spark, spark.createDataFrame(data, "k string, value string"))
        assert rows(values.simplified(df, ["k"])) == Counter(want + more)
        assert seen.value == len(data)
