"""Ordered include/exclude lists: the last rule that matches decides, else the default."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkloom.functions.matcher import member_matcher
from checkloom.operators.graph import reach, subclasses
from checkloom.plans.shared import cut

# Visibility words of the list format; m* test the method, c* its class.
VISIBILITY = ("public", "private", "protected", "default")
LINE = r"^([+-])\s*(\w+)\s+(?:\[([^\]]*)\]\s+)?(.+?)\s*$"
# Record types of the list format.
KINDS = ("ClassPath", "SuperClass", "Interface", "MethodSignature", "MethodName", "MethodNameAndClass", "MethodSpecial")


def parse_rules(lines: DataFrame) -> DataFrame:
    """(idx, include, kind, options, pattern) of lines (idx, value); `//` begins a comment, another form is an error."""
    text = F.trim(F.regexp_replace("value", r"//.*$", ""))
    rows = lines.select("idx", text.alias("t")).where("t <> ''")
    get = lambda i: F.regexp_extract("t", LINE, i)
    bad = ~F.col("t").rlike(LINE) | ~get(2).isin(*KINDS)
    sign = F.when(bad, F.raise_error(F.concat(F.lit("malformed rule: "), F.col("t")))).otherwise(get(1))
    return rows.select("idx", (sign == "+").alias("include"), get(2).alias("kind"), get(3).alias("options"), get(4).alias("pattern"))


def _visible(options: Column, modifiers: Column, prefix: str) -> Column:
    """Options such as `mpublic,cprivate`; `all`, `mall`, `call` stand for all; no option of a side is all of it."""
    o = F.split(options, r"\s*,\s*")
    any_of = F.exists(o, lambda x: F.startswith(x, F.lit(prefix)) | (x == "all"))
    word = F.when(modifiers.bitwiseAND(F.lit(1)) != 0, "public").when(modifiers.bitwiseAND(F.lit(2)) != 0, "private").when(modifiers.bitwiseAND(F.lit(4)) != 0, "protected").otherwise("default")
    return ~any_of | F.array_contains(o, "all") | F.array_contains(o, F.lit(prefix + "all")) | F.array_contains(o, F.concat(F.lit(prefix), word))


def class_path(pattern: Column, name: Column) -> Column:
    """An exact class, or all under it when the pattern ends in `.*` or `$*`."""
    return F.when(pattern.rlike(r"[.$]\*$"), F.startswith(name, F.substring(pattern, F.lit(1), F.length(pattern) - 1))).otherwise(pattern == name)


def _matches(methods: DataFrame, rules: DataFrame, ancestors: DataFrame | None) -> DataFrame:
    """(sig, idx, include) of every match. methods: sig, class, name, subsig, modifiers, class_modifiers; ancestors:
    sub, super, kind ('class' or 'interface'), without the class itself."""
    m = methods
    out = []
    exact = {"MethodSignature": "sig", "MethodName": "name"}
    for kind, column in exact.items():
        r = rules.where(F.col("kind") == kind).select("idx", "include", F.col("pattern").alias(column))
        out.append(m.join(r, column).select("sig", "idx", "include"))
    # class patterns: every prefix of a class name is a key, so prefixes are equi-joins as well
    keys = m.select("sig", "name", "class", "modifiers", "class_modifiers", F.explode(_class_keys(F.col("class"))).alias("key"))
    path = rules.where(F.col("kind") == "ClassPath").select("idx", "include", "options", F.col("pattern").alias("key"))
    out.append(keys.join(path, "key").where(_visible(F.col("options"), F.col("modifiers"), "m") & _visible(F.col("options"), F.col("class_modifiers"), "c")).select("sig", "idx", "include"))
    both = rules.where(F.col("kind") == "MethodNameAndClass").select("idx", "include", F.split("pattern", r"\s+")[0].alias("key"), F.split("pattern", r"\s+")[1].alias("name"))
    out.append(keys.join(both, ["key", "name"]).select("sig", "idx", "include"))
    if ancestors is not None:
        up = m.select("sig", "name", "subsig", F.col("class").alias("sub")).join(ancestors, "sub")
        for kind, what in (("SuperClass", "class"), ("Interface", "interface")):
            r = rules.where(F.col("kind") == kind).select("idx", "include", "options", F.col("pattern").alias("super"))
            hit = up.where(F.col("kind") == what).join(r, "super")
            own = methods.select(F.col("class").alias("super"), "subsig", F.lit(True).alias("own"))
            over = hit.join(own.distinct(), ["super", "subsig"], "left")
            out.append(over.where(~F.array_contains(F.split("options", r"\s*,\s*"), "overrides") | F.col("own")).select("sig", "idx", "include"))
    # composite rules hold a matcher expression each; a list is a configuration file, so they are compiled one by one
    for r in rules.where(F.col("kind") == "MethodSpecial").select("idx", "include", "pattern").collect():
        out.append(_special(m, r, ancestors))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _special(methods: DataFrame, rule, ancestors: DataFrame | None) -> DataFrame:
    """`[IncludeSubClasses=true] [ClassName=pattern] Method=matcher`: the class, its subclasses if asked for, the method."""
    form = re.fullmatch(r"(?:IncludeSubClasses=(\w+)\s+)?(?:ClassName=(\S+)\s+)?Method=(.+)", rule.pattern)
    if not form:
        raise ValueError(f"malformed rule: {rule.pattern}")
    below, cls, method = form.groups()
    hit = methods.where(member_matcher(method, F.col("sig")))
    if cls:
        own = hit.where(class_path(F.lit(cls), F.col("class"))).select("sig")
        if below and below.lower() == "true" and ancestors is not None:
            subs = ancestors.where(class_path(F.lit(cls), F.col("super"))).select(F.col("sub").alias("class")).distinct()
            own = own.unionByName(hit.join(subs, "class", "left_semi").select("sig"))
        hit = own.distinct()
    return hit.select("sig", F.lit(rule.idx).alias("idx"), F.lit(rule.include).alias("include"))


def _class_keys(name: Column) -> Column:
    """The class and the wild-card patterns that cover it."""
    cuts = F.filter(F.transform(F.split(name, ""), lambda c, i: F.when(c.isin(".", "$"), i + 1)), lambda i: i.isNotNull())
    return F.array_union(F.array(name), F.transform(cuts, lambda i: F.concat(F.substring(name, F.lit(1), i), F.lit("*"))))


def decide(methods: DataFrame, rules: DataFrame, default: bool = False, ancestors: DataFrame | None = None) -> DataFrame:
    """(sig, include): the last matching rule's sign, or `default`."""
    last = _matches(methods, rules, ancestors).groupBy("sig").agg(F.max_by("include", "idx").alias("include"))
    return methods.select("sig").distinct().join(last, "sig", "left").select("sig", F.coalesce("include", F.lit(default)).alias("include"))


def decide_classes(classes: DataFrame, rules: DataFrame, default: bool = False, ancestors: DataFrame | None = None) -> DataFrame:
    """(sig, include) for classes (class, modifiers): the same list, on classes."""
    m = classes.select(F.col("class").alias("sig"), "class", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("subsig"), F.lit(1).alias("modifiers"), F.col("modifiers").alias("class_modifiers"))
    return decide(m, rules, default, ancestors)


def runtime_excluded(entry_points: DataFrame) -> DataFrame:
    """(stub, node): the entry points of each stub, which every other entry point of the stub excludes: one row each, not
    one for each pair. `without_runtime_excluded` applies it."""
    return entry_points.select("stub", F.col("ep").alias("node")).distinct()


def without_runtime_excluded(reached: DataFrame, entry_points: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """Rows (ep, node) whose node is no other entry point of the entry point's stub; special: (ep, node) that binders and
    callbacks exclude for one entry point."""
    own = reached.join(entry_points.select("ep", "stub").distinct(), "ep")
    out = own.join(runtime_excluded(entry_points).withColumn("other", F.lit(True)), ["stub", "node"], "left")
    out = out.where(F.col("other").isNull() | (F.col("ep") == F.col("node"))).drop("stub", "other")
    return out if special is None else out.join(special.select("ep", "node").distinct(), ["ep", "node"], "left_anti")


# The classes of the platform whose methods lead nearly everywhere, and the one callback that a class goes to.
BINDER, SHELL, CALLBACK = "android.os.Binder", "android.os.ShellCommand", "com.android.internal.os.HandlerCaller$Callback"
ON_TRANSACT, ON_COMMAND = "onTransact", "int onCommand(java.lang.String)"
ROUTES = {"com.android.printspooler.PrintSpoolerService$PrintSpooler": "com.android.printspooler.PrintSpoolerService$HandlerCallerCallback"}


def without_special_cases(reached: DataFrame, entry_points: DataFrame, parents: DataFrame, methods: DataFrame, outers: DataFrame, routes: dict[str, str] | None = None) -> DataFrame:
    """Rows (ep, node) without what binders, shell commands and callbacks exclude for one entry point. Only rows that are there
    are looked at; no pairs of entry points and methods are made.

    entry_points: ep, stub, class (of the entry point's method); parents: direct (sub, super); methods: node, class, subsig;
    outers: class, outer. For an entry point that the binder class itself implements for a stub below it: the binder's methods
    as other binders implement them, but for the stub's subclasses and onTransact; and shell commands that are not the stub's:
    its own are those inside of its subclasses or beside them in one outer class, else those of a package with them, and if
    there are none all stay. For an entry point in a callback class: what other callback classes implement of the callback;
    a class that `routes` names goes to the callback of one class alone.
    """
    up = cut(subclasses(parents).select("sub", "super"), "special")
    package = lambda c: F.when(F.contains(c, F.lit(".")), F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)).otherwise("")
    below = lambda root: up.where((F.col("super") == root) & (F.col("sub") != root)).select(F.col("sub").alias("class"))
    of = lambda root: methods.where(F.col("class") == root).select("subsig").distinct()
    name = F.regexp_extract("subsig", r"([^\s(]+)\(", 1)
    bound = entry_points.where((F.col("class") == BINDER) & (F.col("stub") != BINDER)).select("ep", "stub").join(below(BINDER).withColumnRenamed("class", "stub"), "stub", "left_semi")
    implemented = methods.join(below(BINDER), "class", "left_semi").join(of(BINDER), "subsig", "left_semi").where(name != ON_TRANSACT).select("node", F.col("class").alias("node_class"))
    subs = up.select(F.col("sub").alias("class"), F.col("super").alias("stub")).join(bound.select("stub").distinct(), "stub", "left_semi")
    commands = cut(methods.join(below(SHELL), "class", "left_semi").where(F.col("subsig") == ON_COMMAND).select("node", "class").join(outers, "class", "left"), "special")
    inside = commands.join(subs.select(F.col("class").alias("outer"), "stub"), "outer").select("stub", "node")
    beside = commands.join(subs.join(outers, "class").select("outer", "stub").distinct(), "outer").select("stub", "node")
    own = cut(inside.union(beside).distinct(), "special")
    near = commands.select("node", package(F.col("class")).alias("package")).join(subs.join(own.select("stub").distinct(), "stub", "left_anti").select("stub", package(F.col("class")).alias("package")).distinct(), "package").select("stub", "node")
    own = cut(own.union(near).distinct(), "special")
    handlers = methods.join(below(CALLBACK), "class", "left_semi").join(of(CALLBACK), "subsig", "left_semi").select("node", F.col("class").alias("handler"))
    route = reached.sparkSession.createDataFrame(list((ROUTES if routes is None else routes).items()), "class string, goes_to string")
    called = entry_points.select("ep", "class").join(F.broadcast(route), "class", "left").join(below(CALLBACK).withColumn("is_callback", F.lit(True)), "class", "left")
    called = called.where("is_callback or goes_to is not null").select("ep", F.coalesce("goes_to", "class").alias("goes_to"))

    x = reached.select("ep", "node").join(bound, "ep", "left").join(implemented, "node", "left")
    x = x.join(up.select(F.col("sub").alias("node_class"), F.col("super").alias("stub"), F.lit(True).alias("mine")), ["node_class", "stub"], "left").where("stub is null or node_class is null or mine")
    x = x.join(commands.select("node", F.lit(True).alias("command")), "node", "left").join(own.select("stub").distinct().withColumn("told", F.lit(True)), "stub", "left").join(own.withColumn("own", F.lit(True)), ["stub", "node"], "left")
    x = x.where("command is null or told is null or own").select("ep", "node")
    x = x.join(called, "ep", "left").join(handlers, "node", "left")
    return x.where("goes_to is null or handler is null or handler = goes_to").select("ep", "node")


def restricted_entry_points(entry_points: DataFrame, edges: DataFrame, stubs: list[str] | None = None, classes: list[str] | None = None) -> DataFrame:
    """Entry points (ep, stub, class) of the listed stubs or classes and all that these refer to, directly or not, over
    edges (ep, ref_ep); without lists all of them."""
    if stubs is None and classes is None:
        return entry_points
    seed = entry_points.where(F.col("stub").isin(stubs or []) | F.col("class").isin(classes or [])).select("ep")
    g = edges.select(F.col("ep").alias("src"), F.col("ref_ep").alias("tgt"))
    found = reach(g, seed.select(F.lit(0).alias("ep"), F.col("ep").alias("node"))).select(F.col("node").alias("ep"))
    return entry_points.join(found, "ep", "left_semi")


# What a proxy class has that goes through no binder, and packages of proxies that are none.
UNWANTED_PROXIES = ("android.test.mock.", "com.android.uiautomator.testrunner.")
GENERATED = ("android.os.IBinder asBinder()", "java.lang.String getInterfaceDescriptor()")


def proxy_methods(methods: DataFrame) -> DataFrame:
    """Methods (class, name, subsig) of proxies that go through the binder."""
    wanted = ~F.col("subsig").isin(*GENERATED) & ~F.col("name").isin("<init>", "<clinit>") & ~F.col("name").rlike(r"^access\$\d{3}$")
    for prefix in UNWANTED_PROXIES:
        wanted = wanted & ~F.startswith("class", F.lit(prefix))
    return methods.where(wanted)


def excluded_edges(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges whose source is not excluded and that touch no class initialiser."""
    init = lambda c: F.contains(F.col(c), F.lit("<clinit>"))
    return edges.where(~init("src") & ~init("tgt")).join(excluded.select(F.col("node").alias("src")), "src", "left_anti")
