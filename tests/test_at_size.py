"""What failed on larger tables. Each test fails on the code before its finding, but that of F6, which only holds results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from checkloom.functions import matcher, values
from checkloom.plans import catalogue


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_numbers_of_wide_types(spark):
    """a value that a type cannot hold is another number; it neither fails nor wraps around."""
    x = spark.createDataFrame([(263,), (7,), (2**40 + 4,), (None,)], "v long")
    m = lambda e: matcher.number_matcher(e, F.col("v"))
    got = x.select("v", m("(byte 7)").alias("b"), m("(short 7)").alias("s"), m("(integer 7)").alias("i"), m("(integer-mask 4)").alias("m"), m("(integer-mask 0x80000000)").alias("h"))
    assert rows(got) == Counter([(263, False, False, False, True, False), (7, True, True, True, True, False), (2**40 + 4, False, False, False, True, False), (None, False, False, False, False, False)])


def test_fold_overflow_of_large_keys(spark, tmp_path):
    """keys beyond a few thousand leave the range in the query's own products."""
    keys = [(1, 1, 3, 5), (2, 1, 5_000_000, 360_000), (3, 2, 7_199_999, 359_999)]
    spark.createDataFrame(keys, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    wrap = lambda x, bits: (x + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1)
    want = []
    for o, n, p, k in keys:
        big, q, i, j = p * 4611686018427 + o, k * 922337203685477, 2147480000 + p, k * 1000
        want.append((o, n, wrap(big * 1000 + q, 64), wrap(big - q * 9999, 64), wrap(big * q, 64), wrap(i + j, 32), wrap(i * j, 32), wrap(i, 8), wrap(i, 16), i % 65536, None, -2147483648))
    assert rows(catalogue.fold_overflow(spark, str(tmp_path))) == Counter(want)


@pytest.mark.parametrize("op", ["+", "-", "*"])
def test_long_arithmetic_wraps_around(spark, op):
    """every sign and both ends of the range, against whole numbers."""
    some = [0, 1, -1, 2**63 - 1, -(2**63), 2**62, -(2**62), 2**32, -(2**32) - 1, 6148914691236517205, -4611686018427387905, 123456789012345678]
    pairs = [(a, b) for a in some for b in some]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", values.fold(op, F.col("a"), F.col("b"), "long", "long", "long"))
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert rows(got) == Counter((a, b, wrap({"+": a + b, "-": a - b, "*": a * b}[op])) for a, b in pairs)


def test_filters_need_no_pairs(spark, monkeypatch):
    """Starts are found from the nodes that fit, without the pairs of starts and used nodes."""
    from checkloom.operators import restrictions as R

    def pairs(*_):
        raise AssertionError("pairs of starts and nodes are made")

    monkeypatch.setattr(R, "used_nodes", pairs)
    # 1 and 2 use 10, which adds 20 and 21 up; 3 uses 30, no arithmetic, and that 20; 4 is in another entry point; 5 and 50 use each other
    edges = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 10, 20), ("a", 10, 21), ("a", 3, 30), ("a", 30, 20), ("b", 4, 20), ("a", 5, 50), ("a", 50, 5), ("a", 50, 21)], "ep string, use long, def long")
    nodes = spark.createDataFrame([("a", 10, "expr", "+", None), ("a", 30, "invoke", None, None), ("a", 50, "expr", "+", None), ("a", 20, "const", None, 7), ("a", 21, "const", None, 8)], "ep string, node long, kind string, expr_op string, const long")
    starts = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("a", 5), ("a", 6), ("a", 20)], "ep string, start long")
    kept = lambda test, r=None: {(x.ep, x.start) for x in R.keep_number_use(starts, nodes, edges, test, r).collect()}
    seven, eight = F.col("const") == 7, F.col("const") == 8
    assert kept(seven) == {("a", 1), ("a", 2), ("a", 3), ("a", 20)} and kept(eight) == {("a", 1), ("a", 2), ("a", 5)}
    assert kept(seven, R.in_arithmetic_chain(nodes, edges)) == {("a", 1), ("a", 2), ("a", 20)}
    assert kept(eight, R.sequence_of(R.in_arithmetic_op(nodes, edges, "+"), R.number_used(nodes, edges, lambda x: x == 7))) == {("a", 1), ("a", 2), ("a", 5)}


def test_closure_of_many_seeds(spark):
    """64 entry points a row, the same rows as the closure by pairs, at every depth."""
    import random

    from checkloom.operators import graph

    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(150)], "src long, tgt long")
    seeds = spark.createDataFrame([(e, rng.randrange(90)) for e in range(150)] + [(7, 3)], "ep long, node long")
    for depth in (None, 0, 2):
        assert rows(graph.reach_dense(edges, seeds, max_level=depth)) == rows(graph.reach(edges, seeds, max_level=depth))


def test_graphml_of_many_files(spark, tmp_path):
    """F16: a large graph is many files, each a document of its own, none larger than asked for by much."""
    import xml.etree.ElementTree as ET

    from checkloom.sources import reports

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1) for i in range(400)], "src string, tgt string, weight int")
    nodes = spark.createDataFrame([(f"n{i}", f"<{i}>", "red") for i in range(401)], "id string, label string, color string")
    reports.write_graphml(nodes, edges, str(tmp_path / "g"), lines=100)
    files = [ET.parse(f).getroot() for f in (tmp_path / "g").rglob("*.txt")]
    assert len(files) == 9 and max(len(f.find("graph")) for f in files) < 200 and sum(len(f.find("graph")) for f in files) == 801
    n, e = reports.read_graphml(spark, str(tmp_path / "g"))
    assert {(r.id, r.data["label"]) for r in n.collect()} == {(f"n{i}", f"<{i}>") for i in range(401)} and e.count() == 400


def test_other_eps_by_distinct_baskets(spark, monkeypatch):
    """baskets that many entry points share are compared once."""
    from checkloom.operators import consistency

    found = spark.createDataFrame([(["a", "b", "x"], ["a"], ["c"]), (["b"], ["b"], ["c", "d"])], "items array<string>, lhs array<string>, rhs array<string>")
    data = [(i, ["a", "b", "c"] if i % 3 else ["a", "c", "d"]) for i in range(30)] + [(99, ["b", "c", "d"]), (98, ["c"])]
    got = consistency.other_eps(found, spark.createDataFrame(data, "ep long, items array<string>"))
    assert {(tuple(r.lhs), tuple(r.eps)) for r in got.collect()} == {(("a",), tuple(range(30))), (("b",), (99,))}
