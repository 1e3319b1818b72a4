import math

import pytest
from pyspark.sql import functions as F

from checkloom.functions import matcher, predicates, text, values


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(x)


def test_split_words(spark):
    names = ["checkUIDPermissionABc", "GET_User_id", "x", "", "ABC", "aBC", "getHTTPResponseCode", "a__b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(df.select("n", text.split_words(F.col("n")).alias("w")).collect())
    assert got["checkUIDPermissionABc"] == "check uid permission a bc"
    assert got["GET_User_id"] == "get user id" and got["getHTTPResponseCode"] == "get http response code" and got["ABC"] == "abc" and got["aBC"] == "a bc" and got[""] == ""
    assert one(spark, w=text.split_class_words(lit("OuterClass$InnerOne$x"))).w == ["x", "inner one", "outer class"]


def test_signature_and_keys(spark):
    p = one(spark, p=text.signature_parts(lit("<com.a.B$C: int[] f(int,java.lang.String)>"))).p
    assert (p.package, p["class"], p.full_class, p.type, p.name, p.args) == ("com.a", "B$C", "com.a.B$C", "int[]", "f", ["int", "java.lang.String"])
    assert one(spark, p=text.signature_parts(lit("no signature"))).p is None
    k = one(spark, k=text.key_of(lit("a_b_K1"))).k
    assert (k.name, k.key) == ("a_b", "K1")
    assert one(spark, x=text.unbase64_url(lit("YT8_Pg=="))).x == "a??>"
    assert one(spark, x=text.descriptor_to_type(lit("[[Lcom/a/B;")), y=text.descriptor_to_type(lit("[J"))).asDict() == {"x": "com.a.B[][]", "y": "long[]"}
    assert one(spark, x=text.round_down(lit(-1.239), 2), y=text.pad_number(lit(7), 3)).asDict() == {"x": -1.23, "y": "007"}
    assert text.largest_remainder([1, 1, 1], 100) == [34, 33, 33] and text.largest_remainder([0, 0]) == [0, 0]
    assert one(spark, x=text.swap_case(lit("aBc")), y=text.initials(lit("ab cd")), z=text.contains_all_words(lit("a bc d"), ["bc", "a"])).asDict() == {"x": "AbC", "y": "ac", "z": True}
    assert one(spark, x=text.rename(lit("com.a.b.C"), [("com.a.**", "org.@1")])).x == "org.b.C"


def test_matcher(spark):
    sig = lit("<com.a.Outer$Inner: boolean checkUidPermission(int)>")
    hit = lambda e: one(spark, x=matcher.member_matcher(e, sig)).x
    for e in ("(starts-with-package com)", "(equal-name_i CHECKUIDPERMISSION)", "(regex-name-words `^check (uid|gid)`)", "(regex-class-words ^inner$ 0)", "(regex-class-words ^outer$)", "(not (or (contain-name x) (equal-class Inner)))", "(and (ends-with-full-class Inner) (regex-package ^com\\.a$))"):
        assert hit(e), e
    for e in ("(regex-class-words ^inner$ 1)", "(equal-name check)", "(regex-class-words a 5)"):
        assert not hit(e), e
    assert one(spark, x=matcher.member_matcher("(not (equal-name a))", lit(None).cast("string"))).x is False
    for bad in ("", "(", "(equal `a)", "(equal a))", "(nope a)", "(not (equal-name a) (equal-name b))", "(equal)", "a", "((equal a))"):
        with pytest.raises(matcher.MatcherError):
            hit(bad)
    tree = "(and (equal `a (b)`) (not (regex `x y`)))"
    assert str(matcher.parse(tree)) == tree and str(matcher.parse(matcher.any_of(["(equal a)", "(equal b)"]))) == "(or (equal a) (equal b))"


def test_numbers(spark):
    assert one(spark, x=matcher.number_matcher("(integer 5)", lit(5), lit("integer"))).x
    assert not one(spark, x=matcher.number_matcher("(integer 5)", lit(5), lit("long"))).x
    assert not one(spark, x=matcher.number_matcher("(double NaN)", lit(math.nan))).x
    assert one(spark, x=matcher.number_matcher("(long-mask 0x10|2)", lit(18))).x and not one(spark, x=matcher.number_matcher("(integer-mask 4)", lit(3))).x


def test_predicates(spark):
    p = predicates.pair(lit("b"), lit("A"))
    assert one(spark, x=predicates.pair_text(p)).x == "{`A`, `b`}" and one(spark, x=predicates.pair_text(predicates.pair(lit(None).cast("string"), lit("z")))).x == "`z`"
    assert one(spark, x=predicates.parse_pair(lit("{`b`, `A`}"))).x.asDict() == {"op1": "A", "op2": "b"}
    call = '<a.B: int f(int,java.lang.String)>(<c.D: int x>, <e.F: int g(int)>(3, "a,(b"))[0]'
    assert predicates.simplify(call) == "<a.B: int f(int,java.lang.String)>[0]"
    keep = {"<a.B: int f(int,java.lang.String)>": (2,), "<g.H: int k(int,int,int,int,int)>": (4, 5)}
    assert predicates.simplify(call, keep) == '<a.B: int f(int,java.lang.String)>(..., <e.F: int g(int)>(3, "a,(b"))[0]'
    assert predicates.simplify("<g.H: int k(int,int,int,int,int)>(1, 2, 3, ALL, -1)", keep) == "<g.H: int k(int,int,int,int,int)>(..., ALL, -1)"
    assert predicates.simplify("<a.B: int flags> & 8") == "<a.B: int flags> & 8" and predicates.simplify("0") == "0"
    texts = [call, "0", "<a.B: int s()>() == 1", "<a.B: int flags> & 8", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(predicates.simplified(F.col("t")).alias("s")).collect()] == [predicates.simplify(t) for t in texts]
    assert one(spark, x=predicates.value_masked(lit("<a.B: int f(int,int)>(1, 2)"), "<a.B: int f(int,int)>")).x == "<a.B: int f(int,int)>(ALL, ALL)"


def test_fold(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    f = lambda op, a, b, ta="int", tb="int", to="int": one(spark, x=values.fold(op, lit(a), lit(b), ta, tb, to)).x
    try:
        assert f("+", 2**31 - 1, 1) == -(2**31) and f("*", 65536, 65536) == 0
        assert f("/", -7, 2) == -3 and f("%", -7, 2) == -1 and f("/", -(2**31), -1) == -(2**31) and f("/", 1, 0) is None
        assert f("<<", 1, 33) == 2 and f(">>", -8, 1) == -4 and f(">>>", -1, 28) == 15
        assert f("+", 200, 100, "short", "short", "byte") == 44 and f("&", 6, 3) == 2 and f("^", 6, 3) == 5
        assert f("cmpl", math.nan, 1.0, "double", "double") == -1 and f("cmpg", math.nan, 1.0, "double", "double") == 1
        assert f("==", math.nan, math.nan, "double", "double", "boolean") == 0 and f("!=", math.nan, 1.0, "double", "double", "boolean") == 1
        assert f("+", -1, 0, "int", "int", "char") == 65535
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_lattice(spark):
    g = lambda *v: one(spark, x=values.simplify_group(F.array(*map(lit, v)))).x
    assert g("ALL", "1", "2") == ["ALL"] and g("ALL", "x", "1") == ["1", "ALL", "x"] and g("NULL", "x") == ["x"] and g("NULL") == ["NULL"]
    assert one(spark, x=values.absorb(lit("ALL"), lit("NONE"), lit("y")), y=values.absorb(lit("a"), lit("NONE"), lit("y"))).asDict() == {"x": "ALL", "y": "NONE"}
    e = one(spark, x=values.unwrap_equals(lit("<java.lang.String: boolean equals(java.lang.Object)>(a, b)"))).x
    assert (e.op1, e.op2) == ("a", "b")
    assert one(spark, x=values.unwrap_boolean(lit("0"), lit("<a.B: boolean c()>()"))).x == "<a.B: boolean c()>()"
