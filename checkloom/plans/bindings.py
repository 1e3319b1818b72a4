"""The driver's tables as stand-ins for the domain's facts, and the same as SQL fragments for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from checkloom.operators.consistency import baskets
from checkloom.operators.graph import union_all


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(items: Column | str) -> Column:
    return F.array_join(items, ",")


def facts(spark, d) -> DataFrame:
    """Checks: stub (order priority), ep (order), op1 (brand), op2 (type), source (supplier), key (return flag)."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    x = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("o_orderpriority").alias("stub"), F.col("l_orderkey").alias("ep"), F.col("p_brand").alias("op1"), F.col("p_type").alias("op2"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("stmt"), F.col("l_returnflag").alias("key"))


FACTS = """f AS (SELECT o_orderpriority AS stub, l_orderkey AS ep, p_brand AS op1, p_type AS op2, l_suppkey AS source, l_linenumber AS stmt, l_returnflag AS key
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def order_baskets(spark, d) -> DataFrame:
    """B1: orders and their distinct brands."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return baskets(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")


ORDER_BASKETS = "b AS (SELECT l_orderkey AS ep, list_sort(list(DISTINCT p_brand)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def event_rows(spark, d) -> DataFrame:
    """B2 as rows: user and day, event type."""
    return table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("ep"), F.col("event_type").alias("item")).distinct()


EVENT_ROWS = "e AS (SELECT DISTINCT concat(user_id, '/', CAST(CAST(ts AS DATE) AS VARCHAR)) AS ep, event_type AS item FROM events)"
EVENT_BASKETS = EVENT_ROWS + ", b AS (SELECT ep, list_sort(list(item)) AS items FROM e GROUP BY ep)"

#: Needs WITH RECURSIVE: a basket's subsets grow item by item.
ITEMSETS = """sub AS (SELECT ep, items, 0 AS k, CAST([] AS VARCHAR[]) AS s FROM b UNION ALL SELECT ep, items, k + 1, u.s FROM (SELECT ep, items, k, unnest([s, list_append(s, items[k + 1])]) AS s FROM sub WHERE k < len(items)) u),
freq AS MATERIALIZED (SELECT s AS items, count(*) AS support FROM sub WHERE k = len(items) AND len(s) > 0 GROUP BY s HAVING count(*) >= 2),
smaller AS (SELECT DISTINCT list_filter(items, lambda y: y <> x) AS items, support FROM (SELECT items, support, unnest(items) AS x FROM freq WHERE len(items) > 1)),
closed AS MATERIALIZED (SELECT f.* FROM freq f ANTI JOIN smaller s ON f.items = s.items AND f.support = s.support)"""

RULES = """n AS (SELECT count(*) AS n FROM b),
cand0 AS (SELECT items AS whole, support, list_filter(items, lambda x, i: ((m >> CAST(i - 1 AS INTEGER)) & 1) = 1) AS lhs FROM (SELECT items, support, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT) - 1)) AS m FROM closed WHERE len(items) >= 2)),
cand AS (SELECT whole, cand0.support, lhs, list_filter(whole, lambda x: NOT list_contains(lhs, x)) AS rhs, l.support AS sup_lhs, cand0.support / (l.support - 1) AS confidence
  FROM cand0 JOIN freq l ON l.items = lhs WHERE l.support > 1 AND cand0.support / (l.support - 1) >= 0.85),
tgt AS (SELECT items, count(*) AS own FROM b GROUP BY items),
held AS (SELECT t.items, coalesce(freq.support, 1) AS sup FROM tgt t LEFT JOIN freq ON t.items = freq.items),
part_of AS (SELECT items, sup, list_filter(items, lambda x, i: ((m >> CAST(i - 1 AS INTEGER)) & 1) = 1) AS lhs FROM (SELECT items, sup, unnest(range(1, CAST(pow(2, len(items)) AS BIGINT))) AS m FROM held WHERE sup = 1 OR len(items) = 1)),
rules AS (SELECT p.items, p.lhs, c.rhs, c.support, c.confidence, c.confidence / (r.support / (n.n - 1)) AS lift,
  CASE WHEN c.confidence = 1 THEN 1.0 ELSE (1 - r.support / (n.n - 1)) / (1 - c.confidence) END AS conviction,
  CASE WHEN len(p.items) = len(p.lhs) THEN -1.0 ELSE (p.sup - 1) / (c.sup_lhs - 1) END AS dconf, len(p.lhs) / len(p.items) AS jaccard
  FROM part_of p JOIN cand c ON p.lhs = c.lhs JOIN freq r ON r.items = c.rhs, n WHERE NOT list_has_any(p.items, c.rhs))"""


def dag(spark, d) -> DataFrame:
    """Region -> nation -> supplier, customer -> order -> part."""
    return dag_rows(spark, d).distinct()


def dag_rows(spark, d) -> DataFrame:
    """The same, a row for each fact."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: table(spark, d, n)
    e = lambda df, a, b: df.select(a.alias("src"), b.alias("tgt"))
    return union_all([
        e(t("nation"), name("r", "n_regionkey"), name("n", "n_nationkey")), e(t("supplier"), name("n", "s_nationkey"), name("s", "s_suppkey")), e(t("customer"), name("n", "c_nationkey"), name("c", "c_custkey")),
        e(t("orders"), name("c", "o_custkey"), name("o", "o_orderkey")), e(t("lineitem"), name("o", "l_orderkey"), name("p", "l_partkey")),
    ])


DAG = """g AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS tgt FROM nation UNION SELECT concat('n', s_nationkey), concat('s', s_suppkey) FROM supplier
  UNION SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM customer UNION SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders UNION SELECT concat('o', l_orderkey), concat('p', l_partkey) FROM lineitem)"""


def regions(spark, d) -> DataFrame:
    r = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    return table(spark, d, "region").select(r.alias("ep"), r.alias("node"))


def ring(spark, d) -> DataFrame:
    """From each supplier of an order to the next one, by line number: dense and cyclic."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("tgt"))
    return x.where("tgt is not null")


RING = "ring AS (SELECT * FROM (SELECT l_orderkey, l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS tgt FROM lineitem) WHERE tgt IS NOT NULL)"


def signatures(spark, d) -> DataFrame:
    """One method signature for each type and brand."""
    sig = F.concat(F.lit("<com."), F.lower("p_type"), F.lit("."), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit(": double getPrice(int)>"))
    return table(spark, d, "part").select(sig.alias("sig"), F.concat(F.lit("com."), F.lower("p_type"), F.lit("."), F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))).alias("class")).distinct()


SIGNATURES = "m AS (SELECT DISTINCT concat('<com.', lower(p_type), '.', replace(p_brand, '#', ''), ': double getPrice(int)>') AS sig, concat('com.', lower(p_type), '.', replace(p_brand, '#', '')) AS class FROM part)"
