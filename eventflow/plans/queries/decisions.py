"""Rules, decisions and named checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from eventflow.operators import decide as d
from eventflow.operators import rule_index
from eventflow.operators.decide import Check, Rule
from eventflow.operators.ordered import ranked
from eventflow.plans.registry import Tables, query


def _gt(field, value):
    return {"op": "gt", "field": field, "value": value}


def _eq(field, value):
    return {"op": "eq", "field": field, "value": value}


ORDER_RULES = [
    Rule("any_open", "watch", (_eq("o_orderstatus", "O"),), priority=1),
    Rule("urgent", "expedite", ({"op": "regex", "field": "o_orderpriority", "pattern": "^1-"},), priority=5),
    Rule("large_open", "manual", (_gt("o_totalprice", 300000), _eq("o_orderstatus", "O")), priority=9),
    Rule("large", "audit", (_gt("o_totalprice", 300000),), priority=5),
]


@query("SELECT o_orderkey, o_totalprice > 300000 AND o_orderstatus = 'O' AS large_open, true AS no_conditions FROM orders")
def rule_match(t: Tables):
    orders = t.orders
    return orders.select(
        "o_orderkey",
        d.matches(ORDER_RULES[2], orders.schema).alias("large_open"),
        d.matches(Rule("all", "x"), orders.schema).alias("no_conditions"),
    )


_DECIDE_SQL = """
CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'manual' WHEN regexp_matches(o_orderpriority, '^1-') THEN 'expedite'
     WHEN o_totalprice > 300000 THEN 'audit' WHEN o_orderstatus = 'O' THEN 'watch' ELSE 'unknown' END
"""


@query(f"SELECT o_orderkey, {_DECIDE_SQL} AS decision FROM orders")
def decide_priority(t: Tables):
    return d.decide(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), ORDER_RULES).select(
        "o_orderkey", "decision"
    )


@query("""
SELECT o_orderkey, o_custkey, o_totalprice,
       CASE WHEN o_orderstatus = 'F' AND o_totalprice > 50 THEN 'approve' ELSE 'reject' END AS decision
FROM orders
""")
def decide(t: Tables):
    rules = [Rule("settled", "approve", (_eq("o_orderstatus", "F"), _gt("o_totalprice", 50)), priority=1)]
    return d.decide(t.orders, rules, default="reject").select("o_orderkey", "o_custkey", "o_totalprice", "decision")


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'large_open' END,
         CASE WHEN regexp_matches(o_orderpriority, '^1-') THEN 'urgent' END,
         CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN o_orderstatus = 'O' THEN 'any_open' END) AS rules
FROM orders
""")
def decide_all_matches(t: Tables):
    orders = t.orders
    return orders.select("o_orderkey", F.array_join(d.matching_rules(ORDER_RULES, orders.schema), ",").alias("rules"))


@query("""
WITH rules AS (
  SELECT p_brand AS brand, p_size AS priority, min(p_partkey) AS ord, max(p_retailprice) * 20 AS bound,
         CASE WHEN max(p_type) = 'STANDARD' THEN 'list' ELSE 'discount' END AS decision
  FROM part GROUP BY p_brand, p_size),
items AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_brand AS brand
          FROM lineitem JOIN part ON p_partkey = l_partkey),
hits AS (
  SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_extendedprice, r.decision,
         row_number() OVER (PARTITION BY i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_extendedprice
                            ORDER BY r.priority DESC, r.ord) AS n
  FROM items i JOIN rules r ON r.brand = i.brand AND i.l_extendedprice > r.bound)
SELECT i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_extendedprice, coalesce(h.decision, 'unknown') AS decision
FROM items i LEFT JOIN (SELECT * FROM hits WHERE n = 1) h
  ON h.l_orderkey = i.l_orderkey AND h.l_linenumber = i.l_linenumber AND h.l_partkey = i.l_partkey
 AND h.l_suppkey = i.l_suppkey AND h.l_extendedprice = i.l_extendedprice
""")
def rules_table_join(t: Tables):
    # One rule per brand and size, drawn from all parts.
    rules = t.part.groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("priority")).agg(
        F.min("p_partkey").alias("ord"),
        (F.max("p_retailprice") * 20).alias("bound"),
        F.when(F.max("p_type") == "STANDARD", "list").otherwise("discount").alias("decision"),
    )
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = lines.join(brands, on="l_partkey")
    decided = d.decide_by_table(items, rules, ["brand"], lambda r: F.col("l_extendedprice") > r["bound"])
    return decided.drop("brand")


@query("""
SELECT o_orderkey, concat_ws('; ', CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'valid_status: Invalid status' END,
                              CASE WHEN NOT (o_totalprice BETWEEN 2000 AND 400000) THEN 'valid_range: Price out of range' END) AS failed
FROM orders
""")
def named_checks(t: Tables):
    checks = [
        Check("valid_status", "o_orderstatus IN ('O', 'F')", "Invalid status"),
        Check("valid_range", "o_totalprice >= 2000 AND o_totalprice <= 400000", "Price out of range"),
    ]
    lines = F.transform(d.failed_checks(checks), lambda f: F.concat(f["name"], F.lit(": "), f["error"]))
    return t.orders.select("o_orderkey", F.array_join(lines, "; ").alias("failed"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_returnflag <> 'R' THEN 'results' WHEN l_linenumber <= 2 THEN 'quarantine' ELSE 'alerts.invalid_output' END AS topic
FROM lineitem
""")
def on_failure_route(t: Tables):
    topic = d.failure_route(
        F.col("l_returnflag") == "R", F.col("l_linenumber"), 2, "results", "quarantine", "alerts.invalid_output"
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", topic.alias("topic"))


@query("SELECT doc_id, length(text) > 500 AND lang = 'en' AS ok FROM documents")
def python_rule(t: Tables):
    @F.pandas_udf("boolean")
    def long_english(text: pd.Series, lang: pd.Series) -> pd.Series:
        return (text.str.len() > 500) & (lang == "en")

    return t.documents.select("doc_id", long_english("text", "lang").alias("ok"))


@query("""
SELECT p_brand AS ruleset, p_partkey AS rule_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS position
FROM part
""")
def rules_sorted(t: Tables):
    rules = t.part.select(F.col("p_brand").alias("ruleset"), F.col("p_partkey").alias("rule_id"), "p_size")
    # Chunks follow the order: by size, and within a size by blocks of rule ids.
    chunk = F.struct(-F.col("p_size"), F.floor(F.col("rule_id") / 10_000))
    sorted_rules = ranked(rules, ["ruleset"], [F.desc("p_size"), F.asc("rule_id")], chunk)
    return sorted_rules.select("ruleset", "rule_id", "position")


@query("""
WITH rules AS (
  SELECT o_custkey % 5 AS class, o_orderkey AS ord, CAST(o_custkey % 100 AS BIGINT) AS priority, 'rule ' || o_orderkey AS decision,
         CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice * 0.2 END AS low,
         CASE WHEN o_orderkey % 70 <> 0 THEN o_totalprice * 0.2 + (o_orderkey % 400) * 25 END AS high FROM orders
  WHERE o_custkey % 7 <> 3 OR o_orderkey % 350 <> 0),
items AS (SELECT row_number() OVER () AS id, l_linenumber % 5 AS class, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
best AS (
  SELECT i.id, arg_min(r.decision, (-r.priority, r.ord)) AS decision
  FROM items i JOIN rules r ON r.class = i.class AND (r.low IS NULL OR i.l_extendedprice >= r.low)
   AND (r.high IS NULL OR i.l_extendedprice < r.high) GROUP BY i.id)
SELECT i.l_orderkey, i.l_partkey, i.l_suppkey, i.l_extendedprice, coalesce(b.decision, 'unknown') AS decision
FROM items i LEFT JOIN best b ON b.id = i.id
""")
def rules_interval_index(t: Tables):
    # One rule per order, by class: thousands that hold for a range of prices each, some open at one end.
    order, price = F.col("o_orderkey"), F.col("o_totalprice") * 0.2
    rules = t.orders.where((F.col("o_custkey") % 7 != 3) | (order % 350 != 0)).select(
        (F.col("o_custkey") % 5).alias("class"),
        order.alias("ord"),
        (F.col("o_custkey") % 100).alias("priority"),
        F.concat(F.lit("rule "), order).alias("decision"),
        F.when(order % 50 != 0, price).alias("low"),
        F.when(order % 70 != 0, price + (order % 400) * 25).alias("high"),
    )
    items = t.lineitem.select((F.col("l_linenumber") % 5).cast("long").alias("class"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    index = rule_index.build(rules, ["class"], "double")
    return rule_index.decide(items, index, "l_extendedprice").drop("class")
