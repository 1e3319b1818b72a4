"""The registered queries over the driver's tables and their SQL; more of them in the modules imported at the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from checkloom.functions import matcher, predicates, values
from checkloom.functions.text import joined_keys, split_words, unbase64_url
from checkloom.operators import cfg, consistency, graph, joins, lookup, pairs, restrictions, rule_lists
from checkloom.operators import values as mining
from checkloom.plans import bindings as B
from checkloom.plans.registry import ORACLE_SQL, QUERIES, query
from checkloom.plans.shared import cut
from checkloom.sources import check_text, reports
from checkloom.streaming import manifest

# --- baskets, look-ups, dumps ---------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_brand AS op1, p_type AS op2 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> p_type")
def check_vocabulary(s, d):
    return consistency.vocabulary(B.facts(s, d))


@query(f"WITH {B.ORDER_BASKETS} SELECT ep, array_to_string(items, ',') AS items FROM b")
def basket_sets(s, d):
    return B.order_baskets(s, d).select("ep", B.text("items").alias("items"))


@query(f"WITH {B.FACTS} SELECT stub, op1, op2, count(DISTINCT source) AS n_sources, count(DISTINCT ep) AS n_eps FROM f GROUP BY ALL")
def pair_sources(s, d):
    return lookup.pair_sources(B.facts(s, d))


@query("""WITH x AS (SELECT o_orderpriority AS stub, o_orderkey AS ep, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has FROM orders)
SELECT count(*) AS n_stubs, CAST(sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS stubs_with, CAST(sum(n) AS BIGINT) AS n_eps, CAST(sum(k) AS BIGINT) AS eps_with FROM (SELECT stub, count(*) AS n, count(*) FILTER (has) AS k FROM x GROUP BY stub)""")
def stub_stats(s, d):
    eps = B.table(s, d, "orders").select(F.col("o_orderpriority").alias("stub"), F.col("o_orderkey").alias("ep"))
    return lookup.statistics(eps, B.facts(s, d))


@query(f"WITH {B.FACTS} SELECT source, string_agg(DISTINCT key, '|' ORDER BY key) AS keys FROM f WHERE op1 = 'Brand#2' AND op2 = 'ECONOMY' GROUP BY source")
def lookup_keyed(s, d):
    return lookup.sources_of(B.facts(s, d), op1="Brand#2", op2="ECONOMY")


@query(f"WITH {B.FACTS} SELECT stub, ep, count(*) AS n FROM f GROUP BY ROLLUP (stub, ep)")
def multi_level_summary(s, d):
    return lookup.summary(B.facts(s, d))


@query(f"""WITH {B.FACTS}, c AS (SELECT ep, source, stmt, string_agg(DISTINCT concat('{{`', op1, '`, `', op2, '`}}'), ';' ORDER BY concat('{{`', op1, '`, `', op2, '`}}')) AS checks FROM
  (SELECT ep, source, stmt, CASE WHEN lower(op1) <= lower(op2) THEN op1 ELSE op2 END AS op1, CASE WHEN lower(op1) <= lower(op2) THEN op2 ELSE op1 END AS op2 FROM f) GROUP BY ALL)
SELECT ep, string_agg(concat(source, ':', stmt, ':', checks), '|' ORDER BY source, stmt) AS dump FROM c GROUP BY ep""")
def check_dump(s, d):
    nested = check_text.by_source(pairs.normalise(B.facts(s, d)), "ep")
    line = lambda x: F.transform(x["stmts"], lambda y: F.concat(x["source"].cast("string"), F.lit(":"), y["stmt"].cast("string"), F.lit(":"), F.array_join(y["checks"], ";")))
    return nested.select("ep", F.array_join(F.flatten(F.transform("sources", line)), "|").alias("dump"))


@query(f"""WITH {B.FACTS} SELECT concat('`', ep, '`; ', string_agg(DISTINCT concat('{{`', CASE WHEN lower(op1) <= lower(op2) THEN op1 ELSE op2 END, '`, `', CASE WHEN lower(op1) <= lower(op2) THEN op2 ELSE op1 END, '`}}'), '; '
  ORDER BY concat('{{`', CASE WHEN lower(op1) <= lower(op2) THEN op1 ELSE op2 END, '`, `', CASE WHEN lower(op1) <= lower(op2) THEN op2 ELSE op1 END, '`}}'))) AS value, stub FROM f GROUP BY stub, ep""")
def check_lines(s, d):
    return check_text.check_lines(pairs.normalise(B.facts(s, d)))


@query(f"WITH {B.FACTS} SELECT stub, CAST(ep AS VARCHAR) AS ep, least(op1, op2) AS op1, greatest(op1, op2) AS op2 FROM f GROUP BY ALL")
def check_text_round_trip(s, d):
    lines = check_text.check_lines(pairs.normalise(B.facts(s, d)))
    return check_text.parse_checks(lines).select("stub", "ep", F.least("op1", "op2").alias("op1"), F.greatest("op1", "op2").alias("op2"))


@query(f"WITH {B.FACTS} SELECT least(op1, op2) AS op1, greatest(op1, op2) AS op2, count(DISTINCT source) AS n_sources FROM f GROUP BY 1, 2")
def merge_sources(s, d):
    m = pairs.merge_sources(B.facts(s, d))
    return m.select(F.least("op1", "op2").alias("op1"), F.greatest("op1", "op2").alias("op2"), F.size("sources").cast("long").alias("n_sources"))


@query("SELECT o_orderkey AS ep, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders")
def split_groups(s, d):
    return lookup.split_sizes(B.table(s, d, "orders").select(F.col("o_orderkey").alias("ep"), "o_custkey"), "o_custkey").select("ep", "group_size")


# --- consistency -----------------------------------------------------------------------------------------------------


@query(f"WITH {B.ORDER_BASKETS} SELECT item, count(*) AS support FROM (SELECT unnest(items) AS item FROM b) GROUP BY item")
def item_support(s, d):
    return B.order_baskets(s, d).select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("support"))


@query(f"WITH {B.ORDER_BASKETS}, e AS (SELECT ep, unnest(items) AS item FROM b) SELECT x.item AS a, y.item AS b, count(*) AS support FROM e x JOIN e y ON x.ep = y.ep AND x.item < y.item GROUP BY 1, 2")
def pair_support(s, d):
    both = lambda x: F.transform(F.filter(F.col("items"), lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return B.order_baskets(s, d).select(F.explode(F.flatten(F.transform("items", both))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("support"))


@query(f"WITH {B.EVENT_ROWS}, t AS (SELECT item, list_sort(list(ep)) AS eps FROM e GROUP BY item) SELECT min(item) AS class_id, string_agg(item, ',' ORDER BY item) AS items, CAST(len(eps) AS INTEGER) AS n_eps FROM t GROUP BY eps")
def collapse_items(s, d):
    return consistency.collapse(B.event_rows(s, d)).select("class_id", B.text("items").alias("items"), F.size("eps").alias("n_eps"))


@query(f"WITH RECURSIVE {B.ORDER_BASKETS}, {B.ITEMSETS} SELECT array_to_string(items, ',') AS items, support FROM closed WHERE len(items) >= 2")
def closed_itemsets(s, d):
    return consistency.closed_itemsets(B.order_baskets(s, d), min_size=2).select(B.text("items").alias("items"), "support")


@query(f"WITH RECURSIVE {B.EVENT_BASKETS}, {B.ITEMSETS} SELECT array_to_string(items, ',') AS items, support FROM closed WHERE len(items) >= 2")
def closed_itemsets_events(s, d):
    rows = consistency.baskets(B.event_rows(s, d), "ep", "item")
    return consistency.closed_itemsets(rows, min_size=2).select(B.text("items").alias("items"), "support")


_NUMBERS = ("confidence", "lift", "conviction", "dconf", "jaccard")


def _rule_columns(df):
    return df.select(*[B.text(c).alias(c) for c in ("items", "lhs", "rhs")], "support", *[F.round(c, 6).alias(c) for c in _NUMBERS])


_RULE_SQL = "array_to_string(items, ',') AS items, array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, support, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS)
_ALL_RULES = f"WITH RECURSIVE {B.ORDER_BASKETS}, {B.ITEMSETS}, {B.RULES}"


@query(f"{_ALL_RULES} SELECT {_RULE_SQL} FROM rules")
def rules_loo(s, d):
    return _rule_columns(consistency.rules(B.order_baskets(s, d)))


def _simple(s, d):
    """Simplified form: the brand's first digit."""
    brand = B.table(s, d, "part").select(F.col("p_brand").alias("item")).distinct()
    return brand.withColumn("simplified", F.substring("item", 1, 7))


def _filtered(s, d):
    return cut(consistency.classify_rhs(consistency.rules(B.order_baskets(s, d)), _simple(s, d)), "rules")


_FILTERED = """split AS (SELECT *, list_filter(rhs, lambda x: NOT list_contains(list_transform(items, lambda y: substr(y, 1, 7)), substr(x, 1, 7))) AS missing,
  list_filter(rhs, lambda x: list_contains(list_transform(items, lambda y: substr(y, 1, 7)), substr(x, 1, 7))) AS alt FROM rules),
kept AS (SELECT * FROM split WHERE len(list_distinct(list_transform(missing, lambda x: substr(x, 1, 7)))) / len(lhs) < 5)"""


@query(f"{_ALL_RULES}, {_FILTERED} SELECT {_RULE_SQL}, array_to_string(missing, ',') AS missing, array_to_string(alt, ',') AS alt FROM kept")
def rule_filters(s, d):
    f = _filtered(s, d)
    return f.select(*[B.text(c).alias(c) for c in ("items", "lhs", "rhs")], "support", *[F.round(c, 6).alias(c) for c in _NUMBERS], B.text("missing").alias("missing"), B.text("alt").alias("alt"))


@query(f"""{_ALL_RULES}, {_FILTERED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY items ORDER BY jaccard DESC, confidence DESC, support DESC, lhs DESC, rhs DESC, dconf DESC, lift DESC) AS rank FROM kept)
SELECT {_RULE_SQL} FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.items = a.items AND b.rank < a.rank AND list_has_all(b.rhs, a.rhs))""")
def rule_redundancy(s, d):
    return _rule_columns(consistency.without_redundant(_filtered(s, d)))


@query(f"""{_ALL_RULES}, left_out AS (SELECT DISTINCT items, lhs, rhs, unnest(list_filter(items, lambda x: NOT list_contains(lhs, x))) AS item FROM rules)
SELECT array_to_string(items, ',') AS items, array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, substr(item, 1, 7) AS simplified, string_agg(item, ',' ORDER BY item) AS unmatched FROM left_out GROUP BY items, lhs, rhs, substr(item, 1, 7)""")
def unmatched_by_form(s, d):
    """What a basket has outside the antecedent, grouped by simplified form."""
    found = consistency.unmatched_by_form(cut(consistency.rules(B.order_baskets(s, d)), "rules"), _simple(s, d))
    return found.select(*[B.text(c).alias(c) for c in ("items", "lhs", "rhs", "unmatched")], "simplified")


@query(f"""WITH RECURSIVE {B.ORDER_BASKETS}, {B.ITEMSETS} SELECT array_to_string(items, ',') AS items, support, row_number() OVER (ORDER BY support DESC, items DESC) AS place FROM closed WHERE len(items) >= 2""")
def itemset_ranking(s, d):
    """Closed itemsets with their place by support, then items."""
    return consistency.ranked_itemsets(consistency.closed_itemsets(B.order_baskets(s, d), min_size=2)).select(B.text("items").alias("items"), "support", "place")


@query(f"{_ALL_RULES} SELECT array_to_string(items, ',') AS items, array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, array_to_string(list_filter(items, lambda x: NOT list_contains(lhs, x)), ',') AS unmatched FROM rules")
def missing_antecedent(s, d):
    return consistency.missing_antecedent(consistency.rules(B.order_baskets(s, d))).select(*[B.text(c).alias(c) for c in ("items", "lhs", "rhs", "unmatched")])


@query(f"""{_ALL_RULES}, w AS (SELECT DISTINCT items, lhs, rhs, list_sort(list_concat(lhs, rhs)) AS whole FROM rules), u AS (SELECT DISTINCT whole FROM w), uw AS (SELECT whole, unnest(whole) AS item FROM u), be AS (SELECT ep, unnest(items) AS item FROM b),
m AS (SELECT whole, ep FROM uw JOIN be ON uw.item = be.item GROUP BY whole, ep HAVING count(*) = len(whole))
SELECT array_to_string(w.items, ',') AS items, array_to_string(lhs, ',') AS lhs, array_to_string(rhs, ',') AS rhs, string_agg(m.ep, ',' ORDER BY m.ep) AS eps FROM w JOIN m ON m.whole = w.whole GROUP BY w.items, lhs, rhs""")
def other_eps(s, d):
    rows = B.order_baskets(s, d)
    out = consistency.other_eps(cut(consistency.rules(rows), "rules"), rows)
    return out.select(*[B.text(c).alias(c) for c in ("items", "lhs", "rhs")], B.text(F.transform("eps", lambda x: x.cast("string"))).alias("eps"))


@query(f"""WITH RECURSIVE b AS (SELECT user_id AS ep, list_sort(list(DISTINCT event_type)) AS items FROM events GROUP BY 1), {B.ITEMSETS}
SELECT array_to_string(items, ',') AS items, support, round(support / (SELECT count(*) FROM b), 6) AS share FROM closed WHERE support / (SELECT count(*) FROM b) >= 0.5""")
def empty_target_itemsets(s, d):
    rows = consistency.baskets(B.table(s, d, "events"), "user_id", "event_type")
    out = consistency.empty_target_itemsets(rows)
    return out.select(B.text("items").alias("items"), "support", F.round("share", 6).alias("share"))


_VENDOR = f"""WITH {B.FACTS}, r AS (SELECT source AS ep, key, op2 AS antecedent, list_sort(list(DISTINCT op1)) AS consequent FROM f GROUP BY 1, 2, 3),
v AS (SELECT * FROM r WHERE key <> 'R'), a AS (SELECT * FROM r WHERE key = 'R')
SELECT v.key AS vendor, v.ep, v.antecedent, array_to_string(list_filter(v.consequent, lambda x: NOT list_contains(a.consequent, x)), ',') AS plus, array_to_string(list_filter(a.consequent, lambda x: NOT list_contains(v.consequent, x)), ',') AS minus,
  array_to_string(list_filter(v.consequent, lambda x: list_contains(a.consequent, x)), ',') AS same FROM v JOIN a ON v.ep = a.ep AND v.antecedent = a.antecedent WHERE v.consequent <> a.consequent"""


@query(_VENDOR)
def vendor_diff(s, d):
    r = B.facts(s, d).groupBy(F.col("source").alias("ep"), "key", "op2").agg(F.sort_array(F.collect_set("op1")).alias("consequent"))
    r = r.select("ep", "key", F.concat_ws("/", "key", "op2").alias("rule_id"), F.array("op2").alias("antecedent"), "consequent")
    out = consistency.vendor_diff(r.where("key <> 'R'"), r.where("key = 'R'"))
    return out.select(F.split("rule_id", "/")[0].alias("vendor"), "ep", F.col("antecedent")[0].alias("antecedent"), *[B.text(c).alias(c) for c in ("plus", "minus", "same")])


_NEXT = f"WITH {B.ORDER_BASKETS}, x AS (SELECT p.ep, p.items AS a, q.items AS c FROM b p JOIN b q ON q.ep = p.ep + 1)"


def _next_pairs(s, d):
    b = B.order_baskets(s, d)
    return b.select("ep", F.col("items").alias("a")).join(b.select((F.col("ep") - 1).alias("ep"), F.col("items").alias("b")), "ep")


@query(f"""{_NEXT} SELECT ep, array_to_string(list_filter(a, lambda i: NOT list_contains(c, i)), ',') AS only_1, array_to_string(list_filter(c, lambda i: NOT list_contains(a, i)), ',') AS only_2, array_to_string(list_filter(a, lambda i: list_contains(c, i)), ',') AS common FROM x""")
def ep_pair_diff(s, d):
    x = _next_pairs(s, d).withColumn("d", consistency.set_diff(F.col("a"), F.col("b")))
    return x.select("ep", B.text("d.plus").alias("only_1"), B.text("d.minus").alias("only_2"), B.text("d.same").alias("common"))


@query(f"{_NEXT} SELECT ep, round(len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))), 6) AS jaccard FROM x")
def jaccard_pairs(s, d):
    return _next_pairs(s, d).select("ep", F.round(consistency.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# --- predicates ------------------------------------------------------------------------------------------------------


@query(f"""WITH {B.SIGNATURES}, p AS (SELECT sig, 'getPrice' AS name, regexp_replace(class, '\\.[^.]*$', '') AS package, regexp_extract(class, '[^.]*$') AS cls, class FROM m)
SELECT sig, starts_with(package, 'com.e') AS starts_package, contains(cls, '1') AS class_1, ends_with(lower(class), 'd7') AS ends_full, regexp_matches(name, '^get') AS regex_name, sig = '<com.economy.Brand2: double getPrice(int)>' AS exact,
  (starts_with(package, 'com.p') OR NOT contains(cls, '2')) AND name = 'getPrice' AS nested FROM p""")
def match_signature(s, d):
    m = lambda e: matcher.member_matcher(e, F.col("sig"))
    return B.signatures(s, d).select(
        "sig", m("(starts-with-package com.e)").alias("starts_package"), m("(contain-class 1)").alias("class_1"), m("(ends-with-full-class_i D7)").alias("ends_full"), m("(regex-name ^get)").alias("regex_name"),
        m("(signature `<com.economy.Brand2: double getPrice(int)>`)").alias("exact"), m("(and (or (starts-with-package com.p) (not (contain-class 2))) (equal-name getPrice))").alias("nested"),
    )


_NAMES = "n AS (SELECT DISTINCT concat(event_type, 'UserIDCheck') AS name FROM events UNION SELECT DISTINCT concat(upper(event_type), '_USER_id') FROM events)"


@query(f"""WITH {_NAMES}, w AS (SELECT name, CASE WHEN contains(name, '_') THEN trim(lower(replace(name, '_', ' '))) ELSE trim(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'))) END AS words FROM n)
SELECT name, words, regexp_matches(words, '\\bid\\b') AS has_id FROM w""")
def match_words(s, d):
    e = B.table(s, d, "events").select("event_type").distinct()
    n = e.select(F.concat("event_type", F.lit("UserIDCheck")).alias("name")).union(e.select(F.concat(F.upper("event_type"), F.lit("_USER_id"))))
    return n.select("name", split_words(F.col("name")).alias("words")).withColumn("has_id", matcher.string_matcher(r"(regex `\bid\b`)", F.col("words")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey & 12) <> 0 AS masked, l_partkey = 7 AS seven, l_quantity = 3.0 AS three FROM lineitem")
def match_number_mask(s, d):
    li = B.table(s, d, "lineitem")
    n = lambda e, c: matcher.number_matcher(e, F.col(c))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", n("(long-mask 4|8)", "l_partkey").alias("masked"), n("(long 7)", "l_partkey").alias("seven"), n("(double 3.0)", "l_quantity").alias("three"))


_LIST = ["+ ClassPath com.*", "- ClassPath [mpublic,call] com.economy.*  // one package", "+ MethodSignature <com.economy.Brand2: double getPrice(int)>", "- MethodNameAndClass com.promo.* getPrice", "+ ClassPath com.promo.Brand1"]


def _methods(s, d):
    m = B.signatures(s, d)
    return m.select("sig", "class", F.lit("getPrice").alias("name"), F.lit("getPrice(int)").alias("subsig"), F.lit(1).alias("modifiers"), F.lit(1).alias("class_modifiers"))


@query(f"""WITH {B.SIGNATURES}, hit AS (SELECT sig, 0 AS idx, true AS inc FROM m WHERE starts_with(class, 'com.') UNION ALL SELECT sig, 1, false FROM m WHERE starts_with(class, 'com.economy.')
  UNION ALL SELECT sig, 2, true FROM m WHERE sig = '<com.economy.Brand2: double getPrice(int)>' UNION ALL SELECT sig, 3, false FROM m WHERE starts_with(class, 'com.promo.') UNION ALL SELECT sig, 4, true FROM m WHERE class = 'com.promo.Brand1')
SELECT m.sig, coalesce(arg_max(inc, idx), false) AS include FROM m LEFT JOIN hit ON m.sig = hit.sig GROUP BY m.sig""")
def rule_list_last_match(s, d):
    rules = rule_lists.parse_rules(s.createDataFrame(list(enumerate(_LIST)), "idx int, value string"))
    return rule_lists.decide(_methods(s, d), rules)


@query("SELECT DISTINCT p_brand AS item, concat('<com.', p_brand, ': int f(int,int)>') AS simple FROM part")
def simplify_predicates(s, d):
    x = B.table(s, d, "part").select(F.col("p_brand").alias("item")).distinct()
    call = F.concat(F.lit("<com."), F.col("item"), F.lit(": int f(int,int)>(<a.B: int g(int)>(3, \"x,y\"), 4)"))
    return x.select("item", predicates.simplified(call).alias("simple"))


@query("SELECT DISTINCT event_type, event_type AS decoded, concat(event_type, '_K1') AS keyed, 'K1|K2' AS keys FROM events")
def encodings(s, d):
    e = B.table(s, d, "events").select("event_type").distinct()
    return e.select("event_type", unbase64_url(F.translate(F.base64(F.encode("event_type", "UTF-8")), "+/", "-_")).alias("decoded"), F.concat("event_type", F.lit("_K1")).alias("keyed"), joined_keys(F.array(F.lit("K2"), F.lit("K1"))).alias("keys"))


# --- graphs ----------------------------------------------------------------------------------------------------------

_REACH = f"WITH RECURSIVE {B.DAG}, w AS (SELECT concat('r', r_regionkey) AS ep, concat('r', r_regionkey) AS node, 0 AS level FROM region UNION SELECT w.ep, g.tgt, w.level + 1 FROM w JOIN g ON w.node = g.src), reached AS (SELECT ep, node, min(level) AS level FROM w GROUP BY 1, 2)"


@query(f"{_REACH} SELECT ep, node, level FROM reached")
def reach_levels(s, d):
    return graph.reach(B.dag(s, d), B.regions(s, d))


@query(f"""WITH RECURSIVE {B.RING}, e AS (SELECT DISTINCT src, tgt FROM ring), w AS (SELECT s_suppkey AS ep, s_suppkey AS node, 0 AS level FROM supplier UNION SELECT w.ep, e.tgt, level + 1 FROM w JOIN e ON w.node = e.src WHERE level < 5)
SELECT ep, node, min(level) AS level FROM w GROUP BY 1, 2""")
def reach_depth_limited(s, d):
    seeds = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("ep"), F.col("s_suppkey").alias("node"))
    return graph.reach_dense(B.ring(s, d), seeds, max_level=5)


@query(f"""WITH RECURSIVE {B.DAG}, x AS (SELECT concat('c', c_custkey) AS node FROM customer WHERE c_mktsegment = 'HOUSEHOLD'),
w AS (SELECT concat('r', r_regionkey) AS ep, concat('r', r_regionkey) AS node, 0 AS level FROM region UNION SELECT w.ep, g.tgt, w.level + 1 FROM w JOIN g ON w.node = g.src WHERE w.node NOT IN (SELECT node FROM x))
SELECT ep, node, min(level) AS level FROM w GROUP BY 1, 2""")
def exclude_then_reach(s, d):
    x = B.table(s, d, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.reach(B.dag(s, d), B.regions(s, d), x)


_BACK = _REACH + """, al AS (SELECT r.ep, g.src, g.tgt FROM reached r JOIN g ON r.node = g.src), sk AS (SELECT concat('p', p_partkey) AS sink FROM part WHERE p_brand = 'Brand#2' AND p_size = 11),
bk AS (SELECT DISTINCT al.ep, sink, sink AS node FROM al JOIN sk ON al.tgt = sink UNION SELECT bk.ep, bk.sink, al.src FROM bk JOIN al ON al.ep = bk.ep AND al.tgt = bk.node)"""


def _allowed(s, d):
    e = B.dag(s, d)
    return cut(graph.allowed_edges(e, graph.reach(e, B.regions(s, d))), "allowed")


def _sinks(s, d):
    return B.table(s, d, "part").where("p_brand = 'Brand#2' and p_size = 11").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("sink"))


@query(f"{_BACK} SELECT ep, sink, node FROM bk")
def reach_backward(s, d):
    return graph.reach_back(_allowed(s, d), _sinks(s, d))


@query(f"{_BACK} SELECT n.ep, n.sink, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges FROM (SELECT ep, sink, count(*) AS n_nodes FROM bk GROUP BY 1, 2) n LEFT JOIN (SELECT al.ep, sink, count(*) AS n_edges FROM al JOIN bk ON al.ep = bk.ep AND al.tgt = bk.node GROUP BY 1, 2) e ON n.ep = e.ep AND n.sink = e.sink")
def sink_report(s, d):
    return graph.sink_overview(_allowed(s, d), _sinks(s, d))


@query(f"{_BACK} SELECT DISTINCT ep, node FROM bk")
def nodes_on_paths(s, d):
    return graph.on_paths(_allowed(s, d), _sinks(s, d))


@query(f"{_REACH} SELECT node, string_agg(ep, ',' ORDER BY ep) AS eps FROM reached WHERE node LIKE 's%' GROUP BY node")
def native_like_report(s, d):
    r = graph.reach(B.dag(s, d), B.regions(s, d)).where("node like 's%'")
    return r.groupBy("node").agg(B.text(F.sort_array(F.collect_set("ep"))).alias("eps"))


@query(f"{_REACH} SELECT DISTINCT ep, node, depth FROM (SELECT ep, node, level AS depth FROM reached UNION SELECT r.ep, g.tgt, r.level + 1 FROM reached r JOIN g ON r.node = g.src)")
def depth_sets(s, d):
    e = B.dag(s, d)
    return graph.depth_sets(e, graph.reach(e, B.regions(s, d)))


@query(f"{_REACH} SELECT n.ep, n.n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT ep, count(*) AS n_nodes FROM reached GROUP BY ep) n LEFT JOIN (SELECT r.ep, count(*) AS n_edges FROM reached r JOIN g ON r.node = g.src WHERE g.tgt <> r.ep GROUP BY r.ep) e ON n.ep = e.ep")
def subgraph_sizes(s, d):
    e = B.dag(s, d)
    return graph.subgraph_sizes(e, graph.reach(e, B.regions(s, d)))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
SELECT CAST(floor((n - lo) / greatest(ceil((hi - lo + 1) / 10), 1)) AS BIGINT) AS bucket, min(n) AS lo, max(n) AS hi, count(*) AS n FROM c, e GROUP BY 1""")
def size_histogram(s, d):
    return graph.size_histogram(B.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")), "size")


@query("""WITH x AS (SELECT c_mktsegment AS k, CAST(floor(o_totalprice / 50000) AS BIGINT) AS depth FROM orders JOIN customer ON o_custkey = c_custkey), e AS (SELECT max(depth) AS m FROM x),
b AS (SELECT i, CASE WHEN i = 1 THEN 0 ELSE m * (i - 1) // 4 + 1 END AS lo, m * i // 4 AS hi FROM e, (SELECT unnest([1, 2, 3, 4]) AS i))
SELECT k, CAST(floor(sum(depth / i) / sum(1 / i) + 0.5) AS INTEGER) AS average FROM x JOIN b ON depth BETWEEN lo AND hi GROUP BY k""")
def depth_weighted(s, d):
    x = B.table(s, d, "orders").join(B.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.select(F.col("c_mktsegment").alias("k"), F.floor(F.col("o_totalprice") / 50000).alias("depth"))
    return x.crossJoin(F.broadcast(x.agg(F.max("depth").alias("most")))).groupBy("k").agg(graph.skewed_average(F.col("depth"), F.col("depth"), F.col("most")).alias("average"))


_COMMON = f"WITH {B.RING}, o AS (SELECT DISTINCT o_orderpriority AS ep, src, tgt FROM ring JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT src, tgt FROM o GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT ep) FROM o))"


def _common(s, d):
    o = B.ring(s, d).join(B.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("ep"), "src", "tgt").distinct()
    o = cut(o, "edges")
    return graph.common_edges(o, o.select("ep").distinct())


@query(f"{_COMMON} SELECT src, tgt FROM c")
def common_edges(s, d):
    return _common(s, d)


@query(f"""{_COMMON.replace("WITH", "WITH RECURSIVE", 1)}, u AS (SELECT src AS a, tgt AS b FROM c WHERE src <> tgt UNION SELECT tgt, src FROM c WHERE src <> tgt), l AS (SELECT DISTINCT a AS node, a AS m FROM u UNION SELECT l.node, u.b FROM l JOIN u ON l.m = u.a), k AS (SELECT node, min(m) AS component FROM l GROUP BY node)
SELECT component, count(*) AS n_nodes, (SELECT count(*) FROM c JOIN k k2 ON c.src = k2.node WHERE k2.component = k.component) AS n_edges, coalesce(string_agg(node, ',' ORDER BY node) FILTER (node NOT IN (SELECT tgt FROM c)), '') AS starts FROM k GROUP BY component""")
def common_components(s, d):
    return graph.common_components(_common(s, d)).select("component", "n_nodes", "n_edges", B.text(F.transform("starts", lambda x: x.cast("string"))).alias("starts"))


@query(f"WITH {B.RING} SELECT src, tgt % 10 AS subsig, count(DISTINCT tgt) AS n_targets FROM ring GROUP BY 1, 2 HAVING count(DISTINCT tgt) > 1")
def ambiguous_dispatch(s, d):
    return graph.ambiguous_dispatch(B.ring(s, d).select("src", (F.col("tgt") % 10).alias("subsig"), "tgt"))


@query("WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT c_mktsegment AS src_class, s_nationkey AS tgt_class, least(count(*), 7) AS weight FROM e JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey GROUP BY 1, 2")
def class_graph(s, d):
    e = B.table(s, d, "orders").join(B.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("tgt")).distinct()
    c = B.table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("class"))
    n = B.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_nationkey").cast("string").alias("class"))
    e = e.select(F.concat(F.lit("c"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("tgt").cast("string")).alias("tgt"))
    return graph.class_graph(e, c.union(n)).withColumn("tgt_class", F.col("tgt_class").cast("int"))


@query(f"WITH RECURSIVE {B.DAG}, w AS (SELECT concat('r', r_regionkey) AS ep, concat('r', r_regionkey) AS node, [concat('r', r_regionkey)] AS path FROM region UNION ALL SELECT w.ep, g.tgt, list_append(w.path, g.tgt) FROM w JOIN g ON w.node = g.src) SELECT ep, node, array_to_string(min(path), '>') AS path FROM w GROUP BY ep, node")
def first_paths(s, d):
    return graph.first_paths(B.dag(s, d), B.regions(s, d)).select("ep", "node", F.array_join("path", ">").alias("path"))


@query(f"WITH {B.DAG} SELECT g.src, g.tgt FROM g")
def graphml_round_trip(s, d):
    e = B.dag(s, d)
    n = e.select(F.col("src").alias("id")).union(e.select("tgt")).distinct()
    lines = reports.graphml(n.select("id", F.col("id").alias("label"), F.lit("red").alias("color")), e.withColumn("weight", F.lit(1)))
    return reports.parse_graphml(lines)[1].select("src", "tgt")


@query("""WITH RECURSIVE p AS (SELECT concat('n', n_nationkey) AS sub, concat('r', n_regionkey) AS super FROM nation UNION SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer),
w AS (SELECT sub, sub AS super, 0 AS distance FROM (SELECT sub FROM p UNION SELECT super FROM p) UNION SELECT w.sub, p.super, distance + 1 FROM w JOIN p ON w.super = p.sub) SELECT sub, super, min(distance) AS distance FROM w GROUP BY 1, 2""")
def subclass_closure(s, d):
    return graph.subclasses(_parents(s, d))


def _parents(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = B.table(s, d, "nation").select(name("n", "n_nationkey").alias("sub"), name("r", "n_regionkey").alias("super"))
    return n.union(B.table(s, d, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))


@query("""SELECT concat('r', r_regionkey) AS call, t AS target FROM (
  SELECT n_regionkey AS r_regionkey, CASE WHEN c_custkey % 3 = 0 THEN concat('c', c_custkey, '.f') WHEN n_nationkey % 2 = 0 THEN concat('n', n_nationkey, '.f') ELSE concat('r', n_regionkey, '.f') END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN concat('n', n_nationkey, '.f') ELSE concat('r', n_regionkey, '.f') END FROM nation UNION SELECT r_regionkey, concat('r', r_regionkey, '.f') FROM region)""")
def virtual_dispatch(s, d):
    p = _parents(s, d)
    c = p.select(F.col("sub").alias("class")).union(p.select("super")).distinct()
    key = F.substring("class", F.lit(2), F.length("class")).cast("long")
    own = F.when(F.startswith("class", F.lit("c")), key % 3 == 0).when(F.startswith("class", F.lit("n")), key % 2 == 0).otherwise(F.lit(True))
    methods = c.where(own).select(F.concat("class", F.lit(".f")).alias("method"), "class", F.lit("f").alias("subsig"))
    calls = B.table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("call")).withColumn("class", F.col("call")).withColumn("subsig", F.lit("f"))
    return graph.dispatch(calls, methods, p)


# --- joins and values -------------------------------------------------------------------------------------------------


@query("""WITH st AS (SELECT s_nationkey AS iface, s_suppkey AS ep, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 7 END AS tx FROM supplier), px AS (SELECT c_nationkey AS iface, c_custkey AS method, c_custkey % 7 AS tx FROM customer)
SELECT DISTINCT method, ep FROM (SELECT method, ep FROM px JOIN st ON px.iface = st.iface AND px.tx = st.tx UNION ALL SELECT method, ep FROM px JOIN st ON px.iface = st.iface AND st.tx IS NULL WHERE NOT EXISTS (SELECT 1 FROM st s2 WHERE s2.iface = px.iface AND s2.tx = px.tx))""")
def binder_join(s, d):
    k = F.col("s_suppkey")
    stubs = B.table(s, d, "supplier").select(F.col("s_nationkey").alias("iface"), k.alias("ep"), F.when(k % 4 != 0, k % 7).alias("tx"))
    proxies = B.table(s, d, "customer").select(F.col("c_nationkey").alias("iface"), F.col("c_custkey").alias("method"), (F.col("c_custkey") % 7).alias("tx"))
    return joins.binder_join(proxies, stubs)


@query(f"WITH {B.DAG}, t AS (SELECT concat('n', s_nationkey) AS method, concat('s', s_suppkey) AS ep FROM supplier) SELECT DISTINCT src, coalesce(ep, tgt) AS tgt FROM g LEFT JOIN t ON g.tgt = t.method")
def edge_rewrite(s, d):
    t = B.table(s, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("method"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ep"))
    return joins.rewrite_edges(B.dag(s, d), t)


_OPS = "op AS (SELECT DISTINCT l_orderkey AS expr, l_linenumber AS pos, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem)"


@query(f"""WITH RECURSIVE {_OPS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY expr ORDER BY pos) AS k FROM op), m AS (SELECT expr, max(k) AS m FROM n GROUP BY expr),
w AS (SELECT expr, k, value AS text FROM n WHERE k = 1 UNION ALL SELECT w.expr, n.k, concat(w.text, ', ', n.value) FROM w JOIN n ON n.expr = w.expr AND n.k = w.k + 1)
SELECT w.expr, w.text FROM w JOIN m ON w.expr = m.expr AND w.k = m.m""")
def substitution_product(s, d):
    # binding B10 whole: an order's lines are its operands, suppliers of one line its alternatives
    x = B.table(s, d, "lineitem").select(F.col("l_orderkey").alias("expr"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").cast("string").alias("value"))
    return joins.substitution_product(x)


@query("SELECT concat('o', o_orderkey) AS node, CAST(coalesce(p.n, 1) AS VARCHAR) AS n FROM orders LEFT JOIN (SELECT l_orderkey, product(k) AS n FROM (SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1) p ON p.l_orderkey = o_orderkey".replace("CAST(coalesce(p.n, 1) AS VARCHAR)", "CAST(CAST(coalesce(p.n, 1) AS BIGINT) AS VARCHAR)"))
def expansion_count(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    defs = B.table(s, d, "lineitem").select(name("o", "l_orderkey").alias("use"), F.col("l_linenumber").alias("operand"), name("s", "l_suppkey").alias("def")).distinct()
    roots = B.table(s, d, "orders").select(name("o", "o_orderkey").alias("node"))
    return mining.expansion_count(defs, roots).where("node like 'o%'").select("node", F.col("n").cast("string").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey + l_suppkey AS BIGINT) AS added, CAST(l_partkey // (l_suppkey + 1) AS BIGINT) AS divided, CAST(l_partkey % (l_suppkey + 1) AS BIGINT) AS rest, CAST(l_partkey << (l_suppkey % 8)::BIGINT AS BIGINT) AS shifted,
  CAST(l_partkey & l_suppkey AS BIGINT) AS anded, CAST(xor(l_partkey, l_suppkey) AS BIGINT) AS xored, CAST(CASE WHEN l_partkey < l_suppkey THEN 1 ELSE 0 END AS INTEGER) AS less, CAST(sign(l_partkey - l_suppkey) AS INTEGER) AS cmp FROM lineitem""")
def fold_values(s, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    f = lambda op, y, to="long": values.fold(op, a, y, "long", "long", to)
    return B.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f("+", b).alias("added"), f("/", b + 1).alias("divided"), f("%", b + 1).alias("rest"), f("<<", b % 8).alias("shifted"),
        f("&", b).alias("anded"), f("^", b).alias("xored"), f("<", b, "int").alias("less"), f("cmp", b, "int").alias("cmp"),
    )


def _wrapped_sql(x: str, bits: int) -> str:
    """x (a hugeint) wrapped around to so many bits."""
    turn, half = 1 << bits, 1 << (bits - 1)
    return f"CAST(((({x}) + {half}) % {turn} + {turn}) % {turn} - {half} AS BIGINT)"


_BIG = "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS HUGEINT) * 4611686018427 + l_orderkey AS p, CAST(l_suppkey AS HUGEINT) * 922337203685477 AS q, CAST(2147480000 + l_partkey AS HUGEINT) AS i, CAST(l_suppkey * 1000 AS HUGEINT) AS j FROM lineitem"


@query(f"""WITH x AS ({_BIG}) SELECT l_orderkey, l_linenumber, {_wrapped_sql("p * 1000 + q", 64)} AS added, {_wrapped_sql("p - q * 9999", 64)} AS taken, {_wrapped_sql("p * q", 64)} AS product, CAST({_wrapped_sql("i + j", 32)} AS INTEGER) AS int_added,
  CAST({_wrapped_sql("i * j", 32)} AS INTEGER) AS int_product, CAST({_wrapped_sql("i", 8)} AS TINYINT) AS as_byte, CAST({_wrapped_sql("i", 16)} AS SMALLINT) AS as_short, CAST(i % 65536 AS INTEGER) AS as_char, CAST(NULL AS BIGINT) AS rest, CAST({_wrapped_sql("CAST(-2147483648 AS HUGEINT) * -1", 32)} AS INTEGER) AS quotient FROM x""")
def fold_overflow(s, d):
    """Arithmetic beyond the types' ranges wraps around, division by zero is null, with ANSI on or off."""
    f = lambda op, a, b, t="long": values.fold(op, a, b, t, t, t)
    part, sup = F.col("l_partkey"), F.col("l_suppkey")
    # large keys leave the types' ranges here already
    big = f("+", f("*", part, F.lit(4611686018427)), F.col("l_orderkey"))
    x = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", big.alias("p"), f("*", sup, F.lit(922337203685477)).alias("q"), values.cast_to(f("+", part, F.lit(2147480000)), "int").alias("i"), values.cast_to(f("*", sup, F.lit(1000)), "int").alias("j"))
    p, q, i, j = (F.col(c) for c in "pqij")
    return x.select(
        "l_orderkey", "l_linenumber", f("+", f("*", p, F.lit(1000)), q).alias("added"), f("-", p, f("*", q, F.lit(9999))).alias("taken"), f("*", p, q).alias("product"), f("+", i, j, "int").alias("int_added"), f("*", i, j, "int").alias("int_product"),
        values.cast_to(i, "byte").alias("as_byte"), values.cast_to(i, "short").alias("as_short"), values.cast_to(i, "char").alias("as_char"), f("%", p, p - p).alias("rest"), f("/", F.lit(-2147483648), F.lit(-1), "int").alias("quotient"),
    )


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'ALL' WHEN l_partkey % 5 = 1 THEN 'NONE' ELSE CAST(l_partkey AS VARCHAR) END AS a, CASE WHEN l_suppkey % 3 = 0 THEN 'NONE' ELSE CAST(l_suppkey AS VARCHAR) END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, a, b, CASE WHEN a = 'ALL' OR b = 'ALL' THEN 'ALL' WHEN a = 'NONE' OR b = 'NONE' THEN 'NONE' ELSE concat(a, ' + ', b) END AS value FROM v""")
def absorb_all(s, d):
    p, k = F.col("l_partkey"), F.col("l_suppkey")
    a = F.when(p % 5 == 0, "ALL").when(p % 5 == 1, "NONE").otherwise(p.cast("string"))
    b = F.when(k % 3 == 0, "NONE").otherwise(k.cast("string"))
    x = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return x.withColumn("value", values.absorb(F.col("a"), F.col("b"), F.concat("a", F.lit(" + "), "b")))


@query("""WITH c AS (SELECT DISTINCT l_suppkey % 5 AS s, l_linenumber AS l, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT CASE WHEN s = 0 THEN concat('<a.B: boolean ok()>', b) WHEN s = 1 THEN concat('<', b, '>') WHEN s = 2 THEN '3' WHEN s = 3 THEN 'NULL' ELSE b END AS o1, CASE WHEN s = 0 THEN '1' WHEN s = 2 THEN CAST(l AS VARCHAR) WHEN s = 4 AND l = 1 THEN b ELSE concat('v', l) END AS o2 FROM c),
y AS (SELECT CASE WHEN o2 = '1' AND o1 LIKE '<%: boolean %' THEN o1 ELSE o1 END AS op1, CASE WHEN o2 = '1' AND o1 LIKE '<%: boolean %' THEN NULL ELSE o2 END AS op2 FROM x),
z AS (SELECT * FROM y WHERE op1 <> 'NULL' AND (op2 IS NULL OR (op1 <> op2 AND NOT (regexp_full_match(op1, '-?\\d+') AND regexp_full_match(op2, '-?\\d+')))))
SELECT DISTINCT CASE WHEN op2 IS NULL OR lower(op1) <= lower(op2) THEN op1 ELSE op2 END AS op1, CASE WHEN op2 IS NULL OR lower(op1) <= lower(op2) THEN op2 ELSE op1 END AS op2 FROM z""")
def simplify_pairs(s, d):
    x = B.table(s, d, "lineitem").join(B.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") % 5).alias("s"), F.col("l_linenumber").alias("l"), F.col("p_brand").alias("b")).distinct()
    c = F.col("s")
    one = F.when(c == 0, F.concat(F.lit("<a.B: boolean ok()>"), "b")).when(c == 1, F.concat(F.lit("<"), "b", F.lit(">"))).when(c == 2, "3").when(c == 3, "NULL").otherwise(F.col("b"))
    two = F.when(c == 0, "1").when(c == 2, F.col("l").cast("string")).when((c == 4) & (F.col("l") == 1), F.col("b")).otherwise(F.concat(F.lit("v"), F.col("l").cast("string")))
    return pairs.simplify(x.select(one.alias("op1"), two.alias("op2")))


@query("SELECT concat('o', o_orderkey) AS node, string_agg(DISTINCT concat('f(', v, ')'), '|' ORDER BY concat('f(', v, ')')) AS vals FROM (SELECT o_orderkey, CASE WHEN l_suppkey % 6 = 0 THEN 'ALL' ELSE concat('s', l_suppkey) END AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_orderkey")
def symbolic_values(s, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    defs = B.table(s, d, "lineitem").select(name("o", "l_orderkey").alias("use"), F.lit(0).alias("operand"), name("s", "l_suppkey").alias("def")).distinct()
    leaves = B.table(s, d, "supplier").select(name("s", "s_suppkey").alias("node"), name("s", "s_suppkey").alias("pattern"), (F.col("s_suppkey") % 6 != 0).alias("allowed"))
    tops = defs.select(F.col("use").alias("node"), F.lit("f({0})").alias("pattern"), F.lit(True).alias("allowed")).distinct()
    return mining.resolve(leaves.union(tops), defs).where("node like 'o%'").select("node", F.array_join(F.sort_array("values"), "|").alias("vals"))


def _du(s, d):
    """Orders as starts, line items as calls below them, parts as constants below these."""
    li = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("call", F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1_000_000_000)
    ep = (F.col("l_orderkey") % 3).cast("string").alias("ep")
    calls = li.select(ep, F.col("call").alias("node"), F.lit("invoke").alias("kind"), F.lit("+").alias("expr_op"), (F.col("l_suppkey") % 10).cast("string").alias("target"), F.lit(None).cast("long").alias("const"))
    consts = li.select(ep, (F.col("l_partkey") + 2_000_000_000_000).alias("node"), F.lit("const").alias("kind"), F.lit(None).cast("string").alias("expr_op"), F.lit(None).cast("string").alias("target"), F.col("l_partkey").alias("const"))
    edges = li.select(ep, F.col("l_orderkey").alias("use"), F.col("call").alias("def")).union(li.select(ep, F.col("call").alias("use"), (F.col("l_partkey") + 2_000_000_000_000).alias("def"))).distinct()
    args = li.select(ep, F.col("call").alias("node"), F.lit(0).alias("pos"), (F.col("l_partkey") + 2_000_000_000_000).alias("def")).distinct()
    starts = B.table(s, d, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("ep"), F.col("o_orderkey").alias("start"))
    return starts, calls.union(consts).distinct(), edges, args


@query("SELECT CAST(o_orderkey % 3 AS VARCHAR) AS ep, o_orderkey AS start FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 10 IN (3, 4))")
def keep_method_use(s, d):
    starts, nodes, edges, _ = _du(s, d)
    return restrictions.keep_method_return_use(starts, nodes, edges, matcher.string_matcher("(or (equal 3) (equal 4))", F.col("target")))


# a constant is an argument of a call of 5 of any start of the entry point
@query("""WITH x AS (SELECT DISTINCT l.l_orderkey % 3 AS ep, k.l_partkey FROM lineitem l JOIN lineitem k ON k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber WHERE l.l_suppkey % 10 = 5)
SELECT DISTINCT CAST(o_orderkey % 3 AS VARCHAR) AS ep, o_orderkey AS start FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN x ON x.ep = o_orderkey % 3 AND x.l_partkey = lineitem.l_partkey WHERE (lineitem.l_partkey & 6) <> 0""")
def keep_number_use(s, d):
    starts, nodes, edges, args = _du(s, d)
    use = restrictions.used_in_call(nodes, args, 0, F.col("target") == "5")
    return restrictions.keep_number_use(starts, nodes, edges, matcher.number_matcher("(long-mask 2|4)", F.col("const")), restrictions.sequence_of(use))


# --- control flow, pages, manifests -------------------------------------------------------------------------------------


def _flow(s, d):
    """A method for each customer: consecutive order priorities by date, as flow edges between five nodes after an entry."""
    from pyspark.sql import Window as W

    o = B.table(s, d, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("n"))
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    x = o.select(F.col("o_custkey").cast("string").alias("method"), F.coalesce(F.lag("n").over(w), F.lit(0).cast("long")).alias("src"), F.col("n").alias("tgt"))
    return x.distinct()


_FLOW = """WITH RECURSIVE f AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS method, coalesce(lag(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS src, n AS tgt FROM (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS n FROM orders)),
nodes AS (SELECT method, src AS node FROM f UNION SELECT method, tgt FROM f)"""
# a node dominates another if there is no way from the entry, 0, to the other without it
_DOMINATORS = _FLOW + """, r AS (SELECT method, node AS skip, CAST(0 AS BIGINT) AS node FROM nodes WHERE node <> 0 UNION SELECT r.method, r.skip, f.tgt FROM r JOIN f ON f.method = r.method AND f.src = r.node WHERE f.tgt <> r.skip),
dom AS (SELECT a.method, a.node, b.node AS dominator FROM nodes a JOIN nodes b ON a.method = b.method LEFT JOIN r ON r.method = a.method AND r.skip = b.node AND r.node = a.node WHERE a.node = b.node OR b.node = 0 OR r.node IS NULL)"""


@query(f"{_DOMINATORS} SELECT method, node, dominator FROM dom")
def control_flow_dominators(s, d):
    return cfg.dominators(_flow(s, d))


@query()
def control_dependence(s, d):
    return cfg.control_dependences(_flow(s, d), closure=True)


@query(f"""{_DOMINATORS}, body AS (SELECT f.method, f.tgt AS header, f.tgt AS node FROM f JOIN dom ON dom.method = f.method AND dom.node = f.src AND dom.dominator = f.tgt UNION SELECT f.method, f.tgt, f.src FROM f JOIN dom ON dom.method = f.method AND dom.node = f.src AND dom.dominator = f.tgt
  UNION SELECT b.method, b.header, f.src FROM body b JOIN f ON f.method = b.method AND f.tgt = b.node WHERE b.node <> b.header),
x AS (SELECT DISTINCT b.method, b.header, b.node FROM body b JOIN f ON f.method = b.method AND f.src = b.node LEFT JOIN body o ON o.method = b.method AND o.header = b.header AND o.node = f.tgt WHERE o.node IS NULL),
e AS (SELECT method, header, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS exits, count(*) AS n FROM x GROUP BY 1, 2)
SELECT b.method, b.header, string_agg(CAST(b.node AS VARCHAR), ',' ORDER BY b.node) AS body, coalesce(any_value(e.exits), '') AS exits, coalesce(any_value(e.n), 0) = 1 AS simple FROM body b LEFT JOIN e ON e.method = b.method AND e.header = b.header GROUP BY 1, 2""")
def natural_loops(s, d):
    x = cfg.loops(_flow(s, d))
    t = lambda c: B.text(F.transform(c, lambda y: y.cast("string"))).alias(c)
    return x.select("method", "header", t("body"), t("exits"), "simple")


_BOTH_WAYS = _FLOW + """, w AS (SELECT method, src AS a, tgt AS b FROM f UNION SELECT w.method, w.a, f.tgt FROM w JOIN f ON f.method = w.method AND f.src = w.b)"""


@query(f"""{_BOTH_WAYS}, m AS (SELECT method, node, node AS o FROM nodes UNION SELECT x.method, x.a, x.b FROM w x JOIN w y ON x.method = y.method AND x.a = y.b AND x.b = y.a),
g AS (SELECT method, node, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS nodes FROM m GROUP BY 1, 2) SELECT DISTINCT method, nodes FROM g""")
def strong_components(s, d):
    return cfg.components_of_methods(_flow(s, d)).select("method", B.text(F.transform("nodes", lambda y: y.cast("string"))).alias("nodes"))


@query(f"{_BOTH_WAYS} SELECT method, b AS node, a AS before FROM w")
def predecessors(s, d):
    """Every node from which a node is reached."""
    return cfg.predecessors(_flow(s, d))


@query(f"{_FLOW} SELECT f.method, f.src, f.tgt, CASE WHEN f.src = 2 AND CAST(f.method AS BIGINT) % 2 = 0 THEN 'red' ELSE 'white' END AS color FROM f")
def flow_view(s, d):
    """Flow graphs with statements of the logic marked; here the color of where an edge begins."""
    f = _flow(s, d)
    logic = f.where("src = 2 and cast(method as bigint) % 2 = 0").select("method", F.col("src").alias("id"))
    nodes, edges = cfg.flow_view(f, logic)
    return edges.join(nodes.select("method", F.col("id").alias("src"), "color"), ["method", "src"]).select("method", "src", "tgt", "color")


@query(f"""{_FLOW}, p AS (SELECT method, src AS first, [src] AS path, tgt FROM f WHERE tgt >= src UNION ALL SELECT p.method, p.first, list_append(p.path, p.tgt), f.tgt FROM p JOIN f ON f.method = p.method AND f.src = p.tgt WHERE p.tgt > p.first AND NOT list_contains(p.path, p.tgt) AND f.tgt >= p.first)
SELECT method, array_to_string(path, ',') AS cycle FROM p WHERE tgt = first""")
def simple_cycles(s, d):
    """Elementary cycles, each from its least node."""
    return cfg.cycles(_flow(s, d)).select("method", B.text(F.transform("cycle", lambda y: y.cast("string"))).alias("cycle"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(s, d):
    return reports.html_links(B.table(s, d, "pages"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 50 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 50 = 0 OR (o_orderkey % 50 <> 0 AND o_orderstatus = 'P')")
def manifest_changes(s, d):
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_totalprice")
    new = o.where("key % 50 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return manifest.changes(manifest.table_manifest(o, "key"), manifest.table_manifest(new, "key"), "key")


from checkloom.plans import catalogue_depth, catalogue_facts, catalogue_text  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue_depth", "catalogue_facts", "catalogue_text"]
