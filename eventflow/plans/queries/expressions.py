"""Guards, paths, conditions and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.functions import json_text, paths, templates
from eventflow.functions.conditions import condition, holds
from eventflow.operators.flow import guarded
from eventflow.operators.route import route_by_rules
from eventflow.plans.registry import Tables, query
from eventflow.sources import topics

from .common import MESSAGES_SQL, PARTIAL_SQL, messages, partial_events

_LABELLED_SQL = "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def labelled(t: Tables):
    """All documents, with labels where there are any."""
    return t.documents.select("doc_id", "lang", "source").join(t.labels, on="doc_id", how="left")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000
                        THEN 'expedite' END AS handling
FROM orders
""")
def guard_filter(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    when = "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000"
    done = guarded(orders, when, {"handling": F.lit("expedite")})
    return done.select("o_orderkey", "handling")


@query(f"""
WITH m AS ({MESSAGES_SQL})
SELECT message_id, subject AS origin,
       CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) ELSE -1 END AS k
FROM m
""")
def path_access(t: Tables):
    body = F.struct(F.try_parse_json("payload").alias("data"), F.struct(F.col("subject").alias("origin")).alias("meta"))
    nested = messages(t.events).select("message_id", body.alias("message"))
    k = paths.field(nested.schema, "message.data.k").cast("bigint")
    return nested.select(
        "message_id",
        paths.field(nested.schema, "message/meta/origin").alias("origin"),
        F.coalesce(k, F.lit(-1)).alias("k"),
    )


@query(f"WITH d AS ({_LABELLED_SQL}) SELECT doc_id, CAST(coalesce(quality, toxic, -1) AS BIGINT) AS grade FROM d")
def null_coalesce(t: Tables):
    grade = paths.first_present(F.col("quality"), F.col("toxic"), F.lit(-1))
    return labelled(t).select("doc_id", grade.cast("bigint").alias("grade"))


@query("""
SELECT event_id, value = 10 AS eq, value <> 10 AS ne, value < 10 AS lt, value <= 10 AS le, value > 10 AS gt, value >= 10 AS ge
FROM events
""")
def expr_compare(t: Tables):
    ops = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return t.events.select("event_id", *[holds(f"value {op} 10").alias(name) for name, op in ops.items()])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net,
       coalesce(round(l_extendedprice / nullif(l_discount, 0), 4), -1) AS ratio, CAST(l_quantity AS BIGINT) % 7 AS rest
FROM lineitem
""")
def expr_arith(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.expr("l_extendedprice * (1 - l_discount) + l_tax"), 4).alias("net"),
        F.coalesce(F.round(F.expr("try_divide(l_extendedprice, l_discount)"), 4), F.lit(-1.0)).alias("ratio"),
        F.expr("CAST(l_quantity AS BIGINT) % 7").alias("rest"),
    )


@query("""
SELECT o_orderkey, (o_totalprice > 200000 AND NOT o_orderstatus = 'F') OR o_orderpriority = '1-URGENT' AS wanted FROM orders
""")
def expr_logic(t: Tables):
    text = "(o_totalprice > 200000 AND NOT o_orderstatus = 'F') OR o_orderpriority = '1-URGENT'"
    return t.orders.select("o_orderkey", holds(text).alias("wanted"))


@query("SELECT event_id, event_type IN ('purchase', 'signup') AS is_key_event FROM events")
def expr_in(t: Tables):
    return t.events.select("event_id", F.col("event_type").isin("purchase", "signup").alias("is_key_event"))


@query(f"WITH d AS ({_LABELLED_SQL}) SELECT doc_id, quality IS NOT NULL AND toxic IS NOT NULL AS complete FROM d")
def required_fields(t: Tables):
    return labelled(t).select("doc_id", paths.all_present([F.col("quality"), F.col("toxic")]).alias("complete"))


@query(f"WITH m AS ({MESSAGES_SQL}) SELECT message_id, json_valid(payload) AS valid FROM m")
def valid_json(t: Tables):
    return messages(t.events).select("message_id", json_text.is_json(F.col("payload")).alias("valid"))


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id,
       coalesce(kind = 'view', false) AS eq_text, coalesce(kind <> 'view', true) AS ne_text,
       coalesce(value > 50, false) AS gt_number, coalesce(value < 50, false) AS lt_number,
       false AS gt_text, true AS ne_absent, false AS eq_absent, value IS NULL AS eq_null
FROM e
""")
def cond_leaf(t: Tables):
    events = partial_events(t.events)
    leaves = {
        "eq_text": {"op": "eq", "field": "kind", "value": "view"},
        "ne_text": {"op": "ne", "field": "kind", "value": "view"},
        "gt_number": {"op": "gt", "field": "value", "value": 50},
        "lt_number": {"op": "lt", "field": "value", "value": 50},
        "gt_text": {"op": "gt", "field": "kind", "value": 50},
        "ne_absent": {"op": "ne", "field": "nowhere", "value": 1},
        "eq_absent": {"op": "eq", "field": "nowhere", "value": 1},
        "eq_null": {"op": "eq", "field": "value", "value": None},
    }
    return events.select("event_id", *[condition(c, events.schema).alias(n) for n, c in leaves.items()])


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id, coalesce(regexp_matches(kind, 'i[ec]'), false) AS found, false AS on_number, false AS bad_pattern FROM e
""")
def cond_regex(t: Tables):
    events = partial_events(t.events)
    leaves = {
        "found": {"op": "regex", "field": "kind", "pattern": "i[ec]"},
        "on_number": {"op": "regex", "field": "value", "pattern": "."},
        "bad_pattern": {"op": "regex", "field": "kind", "pattern": "([a-z"},
    }
    return events.select("event_id", *[condition(c, events.schema).alias(n) for n, c in leaves.items()])


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id,
       coalesce(kind <> 'view', true) AND (coalesce(value > 60, false) OR NOT coalesce(value > 5, false)) AS tree,
       true AS empty_and, false AS empty_or
FROM e
""")
def cond_tree(t: Tables):
    events = partial_events(t.events)
    either = [
        {"op": "gt", "field": "value", "value": 60},
        {"op": "not", "condition": {"op": "gt", "field": "value", "value": 5}},
    ]
    tree = {"op": "and", "conditions": [{"op": "ne", "field": "kind", "value": "view"}, {"op": "or", "conditions": either}]}
    empty = {"empty_and": {"op": "and", "conditions": []}, "empty_or": {"op": "or", "conditions": []}}
    return events.select(
        "event_id",
        condition(tree, events.schema).alias("tree"),
        *[condition(c, events.schema).alias(n) for n, c in empty.items()],
    )


@query("SELECT event_id, event_type AS tx_kind, user_id AS tx_owner, value AS tx_amount FROM events")
def object_input(t: Tables):
    source = t.events.select("event_id", F.struct("event_type", "user_id", "value").alias("tx"))
    built = paths.record(source.schema, {"kind": "tx.event_type", "owner": "tx.user_id", "amount": "tx.value"})
    return source.select("event_id", built.alias("o")).select(
        "event_id",
        F.col("o.kind").alias("tx_kind"),
        F.col("o.owner").alias("tx_owner"),
        F.col("o.amount").alias("tx_amount"),
    )


@query(f"""
WITH e AS ({PARTIAL_SQL})
SELECT event_id, 'User ' || user_id || ' did: ' || coalesce(kind, '') || '. Data ' || props || '.' AS prompt FROM e
""")
def prompt_render(t: Tables):
    events = partial_events(t.events)
    text = templates.render("User {{user_id}} did: {{ kind }}. Data {{props}}{{unknown}}.", events.schema)
    return events.select("event_id", text.alias("prompt"))


@query(f"""
WITH d AS ({_LABELLED_SQL})
SELECT doc_id, 'Source ' || source || CASE WHEN quality IS NOT NULL THEN chr(10) || 'Grade: ' || quality ELSE '' END AS prompt
FROM d
""")
def prompt_if(t: Tables):
    docs = labelled(t)
    text = templates.render("Source {{source}}{{#if quality}}\nGrade: {{quality}}{{/if}}", docs.schema)
    return docs.select("doc_id", text.alias("prompt"))


@query("""
SELECT event_id, CASE WHEN value >= 120 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS risk FROM events
""")
def config_threshold(t: Tables):
    thresholds = {"high": 120.0, "medium": 60.0}
    rules = [(f"value >= {limit}", name) for name, limit in thresholds.items()]
    return t.events.select("event_id", route_by_rules(rules, "low").alias("risk"))


@query("""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, strlen(text) <= 2000 AS accepted FROM documents
""")
def size_guard(t: Tables):
    return t.documents.select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("bytes"),
        topics.within_size(F.col("text"), 2000).alias("accepted"),
    )


@query(f"WITH e AS ({PARTIAL_SQL}) SELECT event_id, coalesce(value, 0.0) AS value, coalesce(kind, 'other') AS kind FROM e")
def default_values(t: Tables):
    return partial_events(t.events).na.fill({"value": 0.0, "kind": "other"}).select("event_id", "value", "kind")
