"""Registered queries of text functions, the matcher language, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checkloom.functions import matcher, predicates, text, values
from checkloom.operators import consistency, lookup, order, pairs
from checkloom.operators import values as mining
from checkloom.plans import bindings as B
from checkloom.plans.registry import query
from checkloom.plans.shared import cut, shared_folder
from checkloom.sources import check_text, reports


def _out(s, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(s)}/checkloom-{name}-{uuid.uuid4().hex}"


# --- matcher families ------------------------------------------------------------------------------------------------

_OPS = {"equal": ("x = p", "equal"), "contain": ("contains(x, p)", "contain"), "starts-with": ("starts_with(x, p)", "starts"), "ends-with": ("ends_with(x, p)", "ends"), "regex": ("regexp_matches(x, p)", "regex")}


def _ops_sql(column: str, pattern: str, prefix: str, also: bool = False) -> str:
    """The five operators on a column as SQL, and with `also` their ignore-case forms."""
    out = []
    for sql, name in _OPS.values():
        out.append(f"{_fill(sql, column, repr(pattern))} AS {prefix}{name}")
        if also:
            low = "regexp_matches(x, p, 'i')" if name == "regex" else sql
            out.append(f"{_fill(low, column if name == 'regex' else f'lower({column})', repr(pattern) if name == 'regex' else repr(pattern.lower()))} AS {prefix}{name}_i")
    return ", ".join(out)


def _fill(sql: str, x: str, p: str) -> str:
    """A template's x and p."""
    name, _, rest = sql.partition("(")
    if not rest:
        return f"{x} = {p}"
    return f"{name}({rest.replace('x', x, 1).replace(' p', ' ' + p, 1)}"


@query(f"SELECT DISTINCT p_type, {_ops_sql('p_type', 'ECONOMY', 'n_', True)} FROM part")
def match_string(s, d):
    x = B.table(s, d, "part").select("p_type").distinct()
    ops = [matcher.string_matcher(f"({op}{i} ECONOMY)", F.col("p_type")).alias(f"n_{name}{i}") for op, (_, name) in _OPS.items() for i in ("", "_i")]
    return x.select("p_type", *ops)


_MEMBERS = "p AS (SELECT sig, class AS whole, regexp_replace(class, '\\.[^.]*$', '') AS package, regexp_extract(class, '[^.]*$') AS cls, 'getPrice' AS name FROM m)"
_FIELDS = {"name": ("name", "getPrice"), "full-class": ("whole", "com.economy.Brand2"), "class": ("cls", "Brand2"), "package": ("package", "com.economy")}


@query(f"WITH {B.SIGNATURES}, {_MEMBERS} SELECT sig, " + ", ".join(_ops_sql(c, p, c + "_", True) for c, p in _FIELDS.values()) + " FROM p")
def match_member(s, d):
    """Each operator on a member's name, full class, class and package, with and without case."""
    sig = F.col("sig")
    cols = [matcher.member_matcher(f"({op}-{field}{i} `{p}`)", sig).alias(f"{c}_{name}{i}") for field, (c, p) in _FIELDS.items() for op, (_, name) in _OPS.items() for i in ("", "_i")]
    return B.signatures(s, d).select("sig", *cols)


@query("""WITH e AS (SELECT DISTINCT event_type FROM events)
SELECT concat('<a.b.Outer$', event_type, 'Inner: int get', event_type, 'ID(int)>') AS sig, regexp_matches(event_type, '^[a-z]') AND NOT contains(event_type, '_') AS plain,
  NOT contains(event_type, '_') AS name_words, true AS any_class, true AS outer_class, false AS absent FROM e""")
def match_member_words(s, d):
    """Words of names and of the parts of nested classes, innermost first."""
    e = B.table(s, d, "events").select("event_type").distinct()
    sig = F.concat(F.lit("<a.b.Outer$"), "event_type", F.lit("Inner: int get"), "event_type", F.lit("ID(int)>"))
    m = lambda x: matcher.member_matcher(x, F.col("sig"))
    x = e.select(sig.alias("sig"), F.col("event_type").alias("t"))
    return x.select("sig", (F.col("t").rlike("^[a-z]") & ~F.contains("t", F.lit("_"))).alias("plain"), m(r"(regex-name-words `^get.*\bid$`)").alias("name_words"), m("(regex-class-words outer)").alias("any_class"), m("(regex-class-words outer 1)").alias("outer_class"), m("(regex-class-words outer 7)").alias("absent"))


@query(f"""WITH {B.SIGNATURES} SELECT sig, (starts_with(class, 'com.p') OR class LIKE '%2') AND NOT class LIKE '%1' AS tree, NOT (starts_with(class, 'com.p') OR class LIKE '%2') AS neither, class LIKE '%2' AS one, false AS nothing FROM m""")
def match_boolean(s, d):
    """Combinators build the same trees as nested text; null never matches."""
    either = matcher.any_of(["(starts-with-full-class com.p)", "(ends-with-full-class 2)"])
    m = lambda x: matcher.member_matcher(x, F.col("sig"))
    return B.signatures(s, d).select("sig", m(matcher.all_of([either, matcher.negated("(ends-with-full-class 1)")])).alias("tree"), m(matcher.negated(either)).alias("neither"), m("(or (ends-with-full-class 2))").alias("one"), matcher.member_matcher(either, F.lit(None).cast("string")).alias("nothing"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey = 7 AS as_int, l_suppkey = 7 AS as_long, l_suppkey = 7 AS as_byte, l_suppkey = 7 AS as_short, l_suppkey = 7 AS as_big, l_quantity = 7 AS as_float, l_quantity = 7 AS as_double, l_quantity = 7 AS as_decimal,
  (l_suppkey & 6) <> 0 AS int_mask, false AS other_type, false AS nan FROM lineitem""")
def match_number(s, d):
    """Every numeric width; a literal of another type than the value's never equals it; NaN never matches."""
    x = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    n = lambda e, c, k=None: matcher.number_matcher(e, F.col(c), k)
    return x.select(
        "l_orderkey", "l_linenumber", n("(integer 7)", "l_suppkey").alias("as_int"), n("(atomic-long 7)", "l_suppkey").alias("as_long"), n("(byte 7)", "l_suppkey").alias("as_byte"), n("(short 7)", "l_suppkey").alias("as_short"), n("(big-integer 7)", "l_suppkey").alias("as_big"),
        n("(float 7)", "l_quantity").alias("as_float"), n("(double 7.0)", "l_quantity").alias("as_double"), n("(big-decimal 7)", "l_quantity").alias("as_decimal"), n("(integer-mask 2|4)", "l_suppkey").alias("int_mask"),
        n("(integer 7)", "l_suppkey", F.lit("long")).alias("other_type"), n("(double NaN)", "l_quantity").alias("nan"),
    )


@query("SELECT DISTINCT p_type, concat('java.util.', p_type) AS type, starts_with(p_type, 'E') AS starts, contains(p_type, 'TAND') AS holds FROM part")
def match_type(s, d):
    t = F.concat(F.lit("java.util."), "p_type")
    return B.table(s, d, "part").select("p_type").distinct().select("p_type", t.alias("type"), matcher.type_matcher("(starts-with java.util.E)", t).alias("starts"), matcher.type_matcher("(and (contain TAND) (not (equal x)))", t).alias("holds"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT p_type, p_brand, CASE WHEN length(p_type) > 6 THEN concat(left(p_type, 3), '...') ELSE p_type END AS short, concat(upper(left(p_brand, 1)), substr(p_brand, 2)) AS capital, concat(upper(left(p_type, 1)), lower(substr(p_type, 2))) AS capital_fully,
  CASE WHEN length(p_type) >= 12 THEN p_type ELSE rpad(concat(repeat('*', CAST(floor((12 - length(p_type)) / 2) AS INTEGER)), p_type), 12, '*') END AS centered, CASE WHEN length(p_brand) >= 10 THEN p_brand ELSE lpad(p_brand, 10, '.') END AS padded_left,
  CASE WHEN length(p_brand) >= 10 THEN p_brand ELSE rpad(p_brand, 10, '.') END AS padded_right, repeat(p_brand, 2) AS twice, CASE WHEN ends_with(p_brand, '1') THEN left(p_brand, length(p_brand) - 1) ELSE p_brand END AS no_end,
  concat(left(p_type, 1), left(p_brand, 1)) AS initials, concat(lower(left(p_brand, 1)), upper(substr(p_brand, 2))) AS swapped, p_type = 'PROMO' AS both_words FROM part""")
def text_functions(s, d):
    x = B.table(s, d, "part").select("p_type", "p_brand").distinct()
    t, b = F.col("p_type"), F.col("p_brand")
    return x.select(
        "p_type", "p_brand", text.abbreviate(t, 6).alias("short"), text.capitalize(b).alias("capital"), text.capitalize_fully(t).alias("capital_fully"), text.center(t, 12, "*").alias("centered"), text.left_pad(b, 10, ".").alias("padded_left"), text.right_pad(b, 10, ".").alias("padded_right"),
        F.repeat(b, F.lit(2)).alias("twice"), text.remove_end(b, "1").alias("no_end"), text.initials(F.concat_ws("  ", t, b)).alias("initials"), text.swap_case(b).alias("swapped"), text.contains_all_words(F.concat_ws(" ", t, F.lit("end")), ["end", "PROMO"]).alias("both_words"),
    )


@query("SELECT DISTINCT p_type, concat(rpad(p_type, 8, '_'), ' one', chr(10), 'two three') AS wrapped FROM part")
def text_wrap(s, d):
    """Lines of twelve characters at most, broken at spaces."""
    x = B.table(s, d, "part").select("p_type").distinct()
    return x.select("p_type", F.rtrim(F.regexp_replace(text.wrap(F.concat(F.rpad("p_type", 8, "_"), F.lit(" one two three")), 12), "\\n$", "")).alias("wrapped"))


@query("""SELECT DISTINCT p_size, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, sign(p_size - 25.0) * floor(abs(p_size - 25) / 7.0 * 100) / 100 AS down, CASE WHEN p_size <= 0 THEN 'red' WHEN p_size = 1 THEN 'orange' WHEN p_size = 2 THEN 'yellow' WHEN p_size = 3 THEN 'green' ELSE 'blue' END AS color,
  CASE WHEN p_size >= 41 THEN '041' WHEN p_size >= 34 THEN '041' WHEN p_size >= 30 THEN '040' WHEN p_size >= 28 THEN '039' WHEN p_size >= 26 THEN '038' WHEN p_size >= 24 THEN '037' WHEN p_size >= 13 THEN '035' END AS dex FROM part""")
def number_functions(s, d):
    x = B.table(s, d, "part").select("p_size").distinct()
    n = F.col("p_size")
    return x.select("p_size", text.pad_number(n, 4).alias("padded"), text.round_down((n - 25) / 7.0, 2).alias("down"), text.depth_color(n).alias("color"), text.dex_version(n).alias("dex"))


@query("""WITH t AS (SELECT DISTINCT p_type, lower(p_type) AS t FROM part)
SELECT p_type, concat('com.', t, '.Item[][]') AS java, 'int[]' AS numbers, 'void' AS nothing, concat('com.', t, '.Item') AS base, 2 AS dims, 'array' AS kind, 'class' AS plain, 'primitive' AS whole, concat('new.', t, '.x') AS renamed, concat('com.', t, '.sub.x') AS kept FROM t""")
def type_functions(s, d):
    """Type descriptors, types as text, and renames by glob patterns."""
    x = B.table(s, d, "part").select("p_type", F.lower("p_type").alias("t")).distinct()
    java = text.descriptor_to_type(F.concat(F.lit("[[Lcom/"), "t", F.lit("/Item;")))
    parsed = text.type_of_text(java)
    rules = [("com.*.x", "new.@1.x"), ("never.**", "no.@1")]
    return x.select(
        "p_type", java.alias("java"), text.descriptor_to_type(F.lit("[I")).alias("numbers"), text.descriptor_to_type(F.lit("V")).alias("nothing"), parsed["base"].alias("base"), parsed["dims"].alias("dims"), parsed["kind"].alias("kind"),
        text.type_of_text(F.concat(F.lit("com."), "t"))["kind"].alias("plain"), text.type_of_text(F.lit("long"))["kind"].alias("whole"), text.rename(F.concat(F.lit("com."), "t", F.lit(".x")), rules).alias("renamed"), text.rename(F.concat(F.lit("com."), "t", F.lit(".sub.x")), rules).alias("kept"),
    )


@query("SELECT DISTINCT p_size, CAST(p_size AS VARCHAR) AS as_int, CAST(NULL AS VARCHAR) AS bad, CASE WHEN p_size * 10 <= 127 THEN CAST(p_size * 10 AS VARCHAR) END AS as_byte, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS as_boolean FROM part")
def typed_values(s, d):
    x = B.table(s, d, "part").select("p_size").distinct()
    t = F.col("p_size").cast("string")
    return x.select("p_size", text.typed_value(t, "int").alias("as_int"), text.typed_value(F.concat(t, F.lit("x")), "long").alias("bad"), text.typed_value((F.col("p_size") * 10).cast("string"), "byte").alias("as_byte"), text.typed_value(F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), "boolean").alias("as_boolean"))


@query("""WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) AS by_key, string_agg(p_brand, ',' ORDER BY p_brand DESC) AS by_key_falling, string_agg(p_brand, ',' ORDER BY n, p_brand) AS by_value, string_agg(p_brand, ',' ORDER BY n DESC, p_brand DESC) AS by_value_falling FROM n GROUP BY p_type""")
def sorted_maps(s, d):
    n = B.table(s, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    m = n.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "n"))).alias("m"))
    keys = lambda by, falling: F.array_join(F.transform(text.sorted_entries(F.col("m"), by, falling), lambda e: e["key"]), ",")
    return m.select("p_type", keys("key", False).alias("by_key"), keys("key", True).alias("by_key_falling"), keys("value", False).alias("by_value"), keys("value", True).alias("by_value_falling"))


@query(f"WITH {B.SIGNATURES} SELECT sig, row_number() OVER (ORDER BY lower(class), class) AS place FROM m")
def member_places(s, d):
    """Places of methods by class, name, arguments and type, case-insensitive first."""
    return order.placed(B.signatures(s, d).select("sig"), *text.member_order(F.col("sig"))).select("sig", "place")


@query("""SELECT DISTINCT p_type, p_brand, concat('<a.B: int f(int,java.lang.String)>(..., "', p_type, '")') AS kept, '<a.B: int f(int,java.lang.String)>' AS bare, concat('<a.B: int f(int,java.lang.String)>(ALL, ALL)') AS masked, concat('<a.B: int f(int,java.lang.String)>.x') AS rest FROM part""")
def call_texts(s, d):
    """Calls without arguments, with some kept by their signature, and with all of them masked; nested calls included."""
    sig = "<a.B: int f(int,java.lang.String)>"
    x = B.table(s, d, "part").select("p_type", "p_brand").distinct()
    call = F.concat(F.lit(sig + "(<c.D: int g(int)>("), "p_brand", F.lit(', 2), "'), "p_type", F.lit('")'))
    return x.select("p_type", "p_brand", predicates.simplified(call, {sig: (2,)}).alias("kept"), predicates.simplified(call).alias("bare"), predicates.value_masked(call, sig).alias("masked"), predicates.simplified(F.concat(call, F.lit(".x"))).alias("rest"))


@query("""SELECT DISTINCT p_size, CASE WHEN p_size % 3 = 0 THEN '<android.app.AppOpsManager: int noteOpNoThrow(int,int,java.lang.String)>(a)' WHEN p_size % 3 = 1 THEN NULL ELSE NULL END AS op FROM part""")
def permission_checks(s, d):
    """A listed call compared with a number is the call alone; other calls and other operands stay as they are."""
    n = F.col("p_size")
    call = F.lit("<android.app.AppOpsManager: int noteOpNoThrow(int,int,java.lang.String)>(a)")
    op1 = F.when(n % 3 == 2, "<a.B: int f()>").otherwise(call)
    op2 = F.when(n % 3 == 1, "x").otherwise(n.cast("string"))
    return B.table(s, d, "part").select("p_size").distinct().select("p_size", predicates.unwrap_permission_check(op1, op2).alias("op"))


@query("SELECT l_orderkey, l_linenumber, CAST(-l_suppkey AS BIGINT) AS minus, CAST(((l_suppkey % 256 + 128) % 256) - 128 AS INTEGER) AS byte_kept, -l_quantity AS real FROM lineitem")
def negated_values(s, d):
    x = B.table(s, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", values.negate(F.col("l_suppkey"), "long").alias("minus"), values.cast_to(F.col("l_suppkey"), "byte").cast("int").alias("byte_kept"), values.negate(F.col("l_quantity"), "double").alias("real"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > l_suppkey THEN 1 WHEN l_quantity = l_suppkey THEN 0 ELSE -1 END AS cmp, -1 AS cmpl, 1 AS cmpg, CAST(false AS INTEGER) AS nan_less, CAST(true AS INTEGER) AS nan_differs, 9223372036854775807 AS most, 0 AS none,
  'Infinity' AS endless, 'NaN' AS undefined FROM lineitem""")
def compare_values(s, d):
    """Comparisons of doubles, NaN included, and what a cast or division makes of values without a whole number."""
    x = B.table(s, d, "lineitem")
    q, nan = F.col("l_quantity").cast("double"), F.lit(float("nan"))
    f = lambda op, a, b, to="int": values.fold(op, a, b, "double", "double", to)
    return x.select(
        "l_orderkey", "l_linenumber", f("cmp", q, F.col("l_suppkey").cast("double")).alias("cmp"), f("cmpl", q, nan).alias("cmpl"), f("cmpg", q, nan).alias("cmpg"), f("<", nan, q).alias("nan_less"), f("!=", nan, q).alias("nan_differs"), values.cast_to(q + F.lit(1e300), "long", "double").alias("most"), values.cast_to(nan, "int", "double").alias("none"),
        f("/", q, F.lit(0.0), "double").cast("string").alias("endless"), f("%", q, F.lit(0.0), "double").cast("string").alias("undefined"),
    )


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def xml_round_trip(s, d):
    path = _out(s, "xml")
    reports.write_xml(B.table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name")), path, "region")
    return reports.read_xml(s, path, "region", "id int, name string")


@query(f"""WITH {B.FACTS}, r AS (SELECT key, op2, string_agg(DISTINCT op1, ',' ORDER BY op1) AS consequent, count(*) AS support FROM f GROUP BY 1, 2) SELECT op2 AS ep, concat(key, '/', op2) AS rule_id, key AS antecedent, consequent, support, CAST(0.5 AS DOUBLE) AS confidence FROM r""")
def rule_xml_round_trip(s, d):
    """Rules written as XML and read back."""
    r = B.facts(s, d).groupBy("key", "op2").agg(F.sort_array(F.collect_set("op1")).alias("consequent"), F.count("*").alias("support"))
    r = r.select(F.col("op2").alias("ep"), F.concat_ws("/", "key", "op2").alias("rule_id"), F.array("key").alias("antecedent"), "consequent", "support", F.lit(0.5).alias("confidence"))
    path = _out(s, "rules")
    reports.write_rules_xml(r, path)
    x = reports.read_rules_xml(s, path)
    return x.select("ep", "rule_id", B.text("antecedent").alias("antecedent"), B.text("consequent").alias("consequent"), "support", "confidence")


@query(f"WITH {B.ORDER_BASKETS} SELECT CAST(ep AS VARCHAR) AS ep, array_to_string(items, ',') AS items FROM b")
def feature_vectors(s, d):
    """Check features written as lines with absent tokens, and read back without these."""
    b = B.order_baskets(s, d)
    lines = b.select(F.concat_ws(",", F.col("ep").cast("string"), F.concat_ws(", ", "items"), F.lit("N_absent")).alias("value"))
    return check_text.parse_features(lines).select("ep", B.text("items").alias("items"))


@query(f"WITH {B.FACTS} SELECT ep, string_agg(DISTINCT concat('{{`', least(op1, op2), '`, `', greatest(op1, op2), '`}}'), ';' ORDER BY concat('{{`', least(op1, op2), '`, `', greatest(op1, op2), '`}}')) AS checks FROM f GROUP BY ep")
def checks_by_ep(s, d):
    x = check_text.by_ep(_plain_pairs(s, d))
    return x.select("ep", F.array_join("checks", ";").alias("checks"))


def _plain_pairs(s, d):
    """Checks with operands in plain order, which for these values is the pairs' own."""
    return B.facts(s, d).withColumn("a", F.least("op1", "op2")).withColumn("op2", F.greatest("op1", "op2")).withColumn("op1", F.col("a")).drop("a")


@query(f"WITH {B.FACTS} SELECT DISTINCT concat('{{`', least(op1, op2), '`, `', greatest(op1, op2), '`}}') AS chk FROM f")
def distinct_checks(s, d):
    return check_text.distinct_pairs(_plain_pairs(s, d)).withColumnRenamed("check", "chk")


@query(f"""WITH {B.FACTS}, c AS (SELECT source, stmt, string_agg(DISTINCT concat('{{`', least(op1, op2), '`, `', greatest(op1, op2), '`}}'), ';' ORDER BY concat('{{`', least(op1, op2), '`, `', greatest(op1, op2), '`}}')) AS checks FROM f GROUP BY 1, 2)
SELECT source, string_agg(concat(stmt, ':', checks), '|' ORDER BY stmt) AS dump FROM c GROUP BY source""")
def checks_by_source(s, d):
    x = check_text.by_source(_plain_pairs(s, d))
    return x.select("source", F.array_join(F.transform("stmts", lambda y: F.concat(y["stmt"].cast("string"), F.lit(":"), F.array_join(y["checks"], ";"))), "|").alias("dump"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS ep, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS members FROM lineitem GROUP BY 1")
def members_by_ep(s, d):
    u = B.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("ep"), F.col("l_suppkey").cast("string").alias("member"))
    return check_text.members(u, "ep").select("ep", B.text("members").alias("members"))


@query("SELECT DISTINCT l_suppkey AS member FROM lineitem")
def members_of_all(s, d):
    return check_text.members(B.table(s, d, "lineitem").select(F.col("l_suppkey").alias("member")))


@query("SELECT l_orderkey AS start, string_agg(DISTINCT concat('f(', l_suppkey, ')'), ',' ORDER BY concat('f(', l_suppkey, ')')) AS texts FROM lineitem GROUP BY 1")
def definition_texts(s, d):
    """The texts of what each start uses."""
    li = B.table(s, d, "lineitem")
    used = li.select(F.lit("e").alias("ep"), F.col("l_orderkey").alias("start"), F.col("l_suppkey").alias("node"))
    nodes = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("node"), mining.node_text("f", F.col("s_suppkey").cast("string")).alias("text"))
    return mining.definitions(B.table(s, d, "orders"), used, nodes).select("start", B.text("texts").alias("texts"))


@query("SELECT l_orderkey AS start, l_suppkey AS def, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS uses FROM lineitem GROUP BY 1, 2")
def uses_by_definition(s, d):
    li = B.table(s, d, "lineitem")
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    used = li.select(F.lit("e").alias("ep"), F.col("l_orderkey").alias("start"), key.alias("node")).distinct()
    x = mining.inverted(used, li.select(key.alias("use"), F.col("l_suppkey").alias("def")).distinct())
    return x.select("start", "def", F.array_join(F.transform("uses", lambda u: F.split(u, "/")[1]), ",").alias("uses"))


@query("SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT r_name FROM region")
def name_lists(s, d):
    """Names of a list with comments and blank lines."""
    n = B.table(s, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit("  // a comment")).alias("value"))
    r = B.table(s, d, "region").select(F.col("r_name").alias("value"))
    return reports.name_list(n.union(r).union(r.select(F.lit("// only a comment"))).union(r.select(F.lit("   "))))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS file, CAST(1 + (rank - 1) // 2 AS BIGINT) AS grp, n_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation)""")
def group_lists(s, d):
    """A list for each region; a line `group` before every other nation."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    n = B.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("file"), rank.alias("rank"), "n_name")
    names = n.select("file", (F.col("rank") * 10).alias("idx"), F.col("n_name").alias("value"))
    heads = n.where("rank % 2 = 1").select("file", (F.col("rank") * 10 - 1).alias("idx"), F.lit("group").alias("value"))
    notes = n.select("file", (F.col("rank") * 10 - 5).alias("idx"), F.lit("// a note").alias("value"))
    return reports.group_list(names.union(heads).union(notes)).withColumnRenamed("group", "grp")


@query("SELECT page_id, trim(substr(t, 8)) AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '>\\s*([^<]+?)\\s*<', 1)) AS t FROM pages) WHERE starts_with(t, '&copy; ')")
def labelled_values(s, d):
    return reports.labelled_texts(B.table(s, d, "pages"), "&copy; ")


@query("SELECT 'a' AS key, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT 'b', CAST(r_regionkey AS BIGINT) FROM region")
def keyed_databases(s, d):
    return reports.keyed({"a": B.table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")), "b": B.table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))}).select("key", "id")


@query(f"WITH {B.DAG} SELECT src AS a, tgt AS b, 'red' AS label FROM g")
def graphml_files(s, d):
    """A graph written as GraphML files and read back by their own keys."""
    e = B.dag(s, d)
    n = e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct()
    path = _out(s, "graphml")
    reports.write_graphml(n.select("id", F.col("id").alias("label"), F.lit("red").alias("color")), e.withColumn("weight", F.lit(1)), path)
    nodes, edges = reports.read_graphml(s, path)
    x = edges.where("data['weight'] = '1'").join(nodes.select(F.col("id").alias("src"), F.expr("data['color']").alias("label")), "src")
    return x.select(F.col("src").alias("a"), F.col("tgt").alias("b"), "label")


@query("""SELECT 0 AS part, concat(n_nationkey, ' ', n_name) AS value FROM nation UNION ALL SELECT 1, '#' UNION ALL SELECT 2, concat(n_regionkey, ' ', n_nationkey, ' 1') FROM nation""")
def tgf_lines(s, d):
    n = B.table(s, d, "nation")
    return reports.tgf(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), n.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("tgt"), F.lit(1).alias("weight")))


@query("SELECT DISTINCT p_type, concat('Confidence: 0.8500', chr(10), chr(9), p_type, chr(10), chr(9), 'b', chr(10), chr(9), '+++ c') AS report FROM part")
def rule_text_report(s, d):
    x = B.table(s, d, "part").select("p_type").distinct()
    return x.select("p_type", reports.rule_text(F.lit(0.85), F.array("p_type", F.lit("b")), F.array(F.lit("c"))).alias("report"))


@query("""WITH b AS (SELECT l_orderkey AS ep, list_sort(list(DISTINCT p_brand)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p.ep, array_to_string(list_filter(p.items, lambda i: NOT list_contains(q.items, i)), ',') AS only_1, array_to_string(list_filter(q.items, lambda i: NOT list_contains(p.items, i)), ',') AS only_2 FROM b p JOIN b q ON q.ep = p.ep + 1""")
def ep_diff_xml(s, d):
    """Differences of entry points written as XML and read back."""
    b = B.order_baskets(s, d)
    x = b.select("ep", F.col("items").alias("a")).join(b.select((F.col("ep") - 1).alias("ep"), F.col("items").alias("b")), "ep").withColumn("d", consistency.set_diff(F.col("a"), F.col("b")))
    path = _out(s, "diff")
    item = lambda c: F.struct(F.col(c).alias("item"))
    reports.write_xml(x.select("ep", item("d.plus").alias("only_1"), item("d.minus").alias("only_2")), path, "diff")
    y = reports.read_xml(s, path, "diff", "ep long, only_1 struct<item:array<string>>, only_2 struct<item:array<string>>")
    some = lambda c: F.coalesce(F.array_join(F.col(f"{c}.item"), ","), F.lit("")).alias(c)
    return y.select("ep", some("only_1"), some("only_2"))


@query("""WITH x AS (SELECT p_partkey AS k, p_name AS n FROM part)
SELECT CASE k % 6 WHEN 0 THEN 'query' WHEN 1 THEN 'tested' WHEN 2 THEN 'method' WHEN 3 THEN 'field' WHEN 4 THEN 'tested_field' ELSE 'string' END AS form, CASE WHEN k % 6 < 5 THEN concat('a.b.C', k) END AS class, CASE WHEN k % 6 < 5 THEN 'int' END AS type, CASE WHEN k % 6 < 5 THEN 'f' END AS name,
  CASE WHEN k % 6 < 3 THEN 2 WHEN k % 6 < 5 THEN 0 END AS n_args, CASE WHEN k % 6 = 5 THEN concat(n, ' "', k, '"') END AS value FROM x""")
def filter_facts(s, d):
    """Fact lines of six forms, among lines that are none."""
    k = F.col("p_partkey")
    own = F.concat(F.lit("<a.b.C"), k.cast("string"))
    method, field = F.concat(own, F.lit(": int f(int,long)>")), F.concat(own, F.lit(": int f>"))
    line = F.when(k % 6 == 0, F.concat(F.lit("+ MethodSignature "), method)).when(k % 6 == 1, F.concat(F.lit("Method: "), method)).when(k % 6 == 2, method).when(k % 6 == 3, field).when(k % 6 == 4, F.concat(F.lit("Field: "), field))
    line = line.otherwise(F.concat(F.lit('StringConst: "'), "p_name", F.lit(' "'), k.cast("string"), F.lit('""')))
    x = B.table(s, d, "part").select(line.alias("value"))
    return reports.filter_facts(x.union(x.select(F.lit("# no fact")))).select("form", "class", "type", "name", F.when(F.col("args").isNotNull(), F.size("args")).alias("n_args"), "value")


@query("SELECT CAST(page_id AS VARCHAR) AS path, concat('<e', page_id % 7, '>') AS ep FROM pages WHERE strlen(html) > 3000")
def large_files(s, d):
    p = B.table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.octet_length("html").alias("length"), F.concat(F.lit("x <!-- <e"), (F.col("page_id") % 7).cast("string"), F.lit("> -->")).alias("text"))
    return lookup.large_files(p, 3000)


@query("SELECT 'first' AS side, o_orderpriority AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 2")
def list_differences(s, d):
    """A list against the same list without some of its entries."""
    o = B.table(s, d, "orders")
    return lookup.list_diff(o.select(F.col("o_orderpriority").alias("name")), o.where("o_orderstatus <> 'P'").select(F.col("o_orderpriority").alias("name"))).groupBy("side", "name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS key, md5(o_orderstatus) AS hash FROM orders")
def content_hashes(s, d):
    return B.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.md5(F.col("o_orderstatus").cast("binary")).alias("hash"))


@query(f"WITH {B.FACTS} SELECT op1, op2, count(DISTINCT ep) AS eps FROM f GROUP BY 1, 2")
def check_spread(s, d):
    """How many entry points have each check."""
    return pairs.ambiguous(cut(B.facts(s, d).select("op1", "op2", "ep"), "spread"))


@query(f"WITH {B.FACTS}, x AS (SELECT DISTINCT ep, concat('<a.', op1, ': int f(int)>(1)') AS op1, op2 FROM f) SELECT ep, op1, op2 FROM x WHERE op1 NOT LIKE '<a.Brand#1:%'")
def removed_queries(s, d):
    """Checks whose first call is in the removal set go."""
    x = B.facts(s, d).select("ep", F.concat(F.lit("<a."), "op1", F.lit(": int f(int)>(1)")).alias("op1"), "op2").distinct()
    gone = s.createDataFrame([("<a.Brand#1: int f(int)>",)], "target string")
    return pairs.without_queries(x, gone).select("ep", "op1", "op2")
