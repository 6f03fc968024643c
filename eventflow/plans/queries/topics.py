"""Sources, sinks and the envelope."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from eventflow.functions import json_text
from eventflow.operators.decide import Rule, decide
from eventflow.session import shared_folder
from eventflow.sources import context, custom, resources, targets, timer, topics, versions
from eventflow.plans.registry import Tables, query

from .common import BODY, MESSAGES_SQL, messages


@query("SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'click'")
def topic_scan(t: Tables):
    source = topics.Topic(f"{t.folder}/events.parquet")
    return topics.read(t.spark, source).where(F.col("event_type") == "click").select("event_id", "ts", "user_id", "value")


@query("SELECT event_id, 'prod.' || event_type AS subject FROM events")
def subject_prefix(t: Tables):
    return t.events.select("event_id", topics.prefixed(F.col("event_type"), "prod.").alias("subject"))


@query("SELECT event_id, ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 4 AS member FROM events")
def queue_group_assign(t: Tables):
    return t.events.select("event_id", topics.member_of_group(F.col("event_id"), 4).alias("member"))


@query("""
WITH m AS (SELECT * FROM (VALUES ('a', 1.0, 0), ('b', 1.0, 0), ('c', 2.0, 0), ('d', 1.0, 1)) AS t(name, weight, late)),
     d AS (SELECT event_id, name, late, -ln((('0x' || substr(md5(name || '/' || event_id), 1, 12))::BIGINT + 1) / 281474976710656.0) / weight AS draw
           FROM events, m)
SELECT event_id, arg_min(name, draw) FILTER (late = 0) AS before, arg_min(name, draw) AS after FROM d GROUP BY event_id
""")
def queue_group_members(t: Tables):
    # A member joins a group of three, one of which takes twice the others' share.
    group = {"a": 1.0, "b": 1.0, "c": 2.0}
    before, after = (topics.member_by_weight(F.col("event_id"), g) for g in (group, {**group, "d": 1.0}))
    return t.events.select("event_id", before.alias("before"), after.alias("after"))


@query("""
SELECT event_id, subscriber
FROM events, (VALUES ('audit'), ('billing'), ('search')) AS s(subscriber)
""")
def pubsub_fanout(t: Tables):
    return topics.fan_out(t.events.select("event_id"), ["audit", "billing", "search"])


@query("""
SELECT CAST(event_id AS VARCHAR) AS message_id, event_type AS header_type,
       CAST(user_id AS VARCHAR) AS header_user, false AS has_trace
FROM events
""")
def headers_lookup(t: Tables):
    return messages(t.events).select(
        "message_id",
        topics.header("type").alias("header_type"),
        topics.header("user").alias("header_user"),
        topics.header("trace").isNotNull().alias("has_trace"),
    )


@query("""
SELECT CASE WHEN value >= 150 THEN 'alerts.high' WHEN value >= 80 THEN 'alerts.medium' ELSE 'processed' END AS topic,
       count(*) AS n
FROM events GROUP BY 1
""")
def multi_target_counts(t: Tables):
    value = F.col("value")
    topic = F.when(value >= 150, "alerts.high").when(value >= 80, "alerts.medium").otherwise("processed")
    return t.events.select(topic.alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query("""
SELECT 'customer' AS origin, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
""")
def multi_source_union(t: Tables):
    customers = t.customer.select(
        F.lit("customer").alias("origin"),
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t.supplier.select(
        F.lit("supplier").alias("origin"),
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
    )
    return topics.merge(customers, suppliers)


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def file_scan(t: Tables):
    files = resources.get(t.spark, f"{t.folder}/documents.parquet", format="parquet")
    return files.select("doc_id", "lang", "source", "n_chars")


@query("""
WITH r AS (SELECT date_trunc('day', min(ts)) AS lo, max(ts) AS hi FROM events),
     s AS (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), hi, INTERVAL 7 HOUR)) AS tick FROM r),
     c AS (SELECT date_trunc('hour', ts) AS tick, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(s.tick AS TIMESTAMP) AS tick, coalesce(c.n, 0) AS n
FROM s LEFT JOIN c ON CAST(c.tick AS TIMESTAMP) = s.tick
""")
def timer_ticks(t: Tables):
    every_seven = timer.ticks(t.events, "ts", "INTERVAL '7' HOUR")
    hour = F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("tick")
    seen = t.events.groupBy(hour).agg(F.count("*").alias("n"))
    return every_seven.join(seen, on="tick", how="left").select("tick", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
SELECT o_orderkey, c_name, c_mktsegment
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def database_lookup(t: Tables):
    table = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    found = context.database_lookup(t.orders.select("o_orderkey", "o_custkey"), table, {"c_custkey": "o_custkey"})
    return found.select("o_orderkey", "c_name", "c_mktsegment")


@query("""
SELECT s_suppkey, s_name, count(*) AS n_items
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE s_acctbal > 500 GROUP BY 1, 2
""")
def context_sql_filter(t: Tables):
    rich = context.sql_context(t.spark, "SELECT s_suppkey, s_name FROM {s} WHERE s_acctbal > 500", s=t.supplier)
    per_supplier = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_items"))
    return rich.join(per_supplier, on="s_suppkey").select("s_suppkey", "s_name", "n_items")


@query("""
SELECT c_custkey, n_name, r_name
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def context_broadcast(t: Tables):
    nations = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    known = nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return context.lookup(t.customer.select("c_custkey", "c_nationkey"), known, ["c_nationkey"]).drop("c_nationkey")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
def replay_from(t: Tables):
    return topics.replay_from(t.events, "2024-01-15 12:00:00").select("event_id", "ts", "event_type")


@query(f"""
WITH m AS ({MESSAGES_SQL})
SELECT message_id,
       CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) ELSE -1 END AS k,
       CASE WHEN NOT json_valid(payload) THEN 'invalid JSON payload' END AS decode_error
FROM m
""")
def json_decode(t: Tables):
    decoded = json_text.decode(messages(t.events), BODY)
    return decoded.select("message_id", F.coalesce("body.k", F.lit(-1)).alias("k"), "decode_error")


@query("""
SELECT event_id, event_type AS encoded_type, user_id AS encoded_user, true AS well_formed FROM events
""")
def json_encode(t: Tables):
    text = json_text.encode(F.col("event_id"), F.col("event_type").alias("type"), F.struct("user_id", "value").alias("body"))
    encoded = t.events.select("event_id", text.alias("payload"))
    return encoded.select(
        "event_id",
        F.get_json_object("payload", "$.type").alias("encoded_type"),
        F.get_json_object("payload", "$.body.user_id").cast("bigint").alias("encoded_user"),
        json_text.is_json(F.col("payload")).alias("well_formed"),
    )


@query(f"""
WITH m AS ({MESSAGES_SQL})
SELECT message_id, 'results' AS topic FROM m
UNION ALL
SELECT message_id, reply_to FROM m WHERE reply_to IS NOT NULL
""")
def reply_fanout(t: Tables):
    return topics.reply_fan_out(messages(t.events), "results").select("message_id", "topic")


@query("""
SELECT CAST(event_id AS VARCHAR) AS message_id, 'replies.' || user_id AS topic,
       CASE WHEN value > 100 THEN 'review' ELSE 'accept' END AS decision
FROM events WHERE event_type = 'purchase'
""")
def decision_reply(t: Tables):
    rules = [Rule("large", "review", ({"op": "gt", "field": "value", "value": 100},))]
    sent = messages(t.events, "value")
    decided = decide(sent, rules, default="accept")
    return topics.reply_fan_out(decided, None).select("message_id", "topic", "decision")


_URIS_SQL = """
SELECT 'page' AS origin, page_id AS id, url AS uri FROM pages
UNION ALL
SELECT 'document', doc_id,
       CASE lang WHEN 'en' THEN 'file:///' || source WHEN 'fr' THEN 'FTP://' || source ELSE source END
FROM documents
"""


@query(f"""
WITH u AS ({_URIS_SQL}),
     s AS (SELECT origin, id, nullif(lower(regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)), '') AS scheme FROM u)
SELECT origin, id, scheme, coalesce(scheme IN ('file', 'http', 'https'), false) AS readable,
       coalesce(scheme = 'file', false) AS writable,
       CASE WHEN scheme IS NULL THEN 'invalid URI'
            WHEN scheme NOT IN ('file', 'http', 'https') THEN 'unsupported scheme: ' || scheme END AS error
FROM s
""")
def uri_scheme(t: Tables):
    pages = t.pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("url").alias("uri"))
    uri = (
        F.when(F.col("lang") == "en", F.concat(F.lit("file:///"), "source"))
        .when(F.col("lang") == "fr", F.concat(F.lit("FTP://"), "source"))
        .otherwise(F.col("source"))
    )
    documents = t.documents.select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), uri.alias("uri"))
    return topics.merge(pages, documents).select("origin", "id", resources.dispatch(F.col("uri")).alias("d")).select(
        "origin", "id", "d.*"
    )


@query("SELECT event_id, ts, user_id, event_type FROM events")
def dedup_messages(t: Tables):
    # At-least-once delivery: everything but sign-ups arrives twice.
    events = t.events.select("event_id", "ts", "user_id", "event_type")
    again = events.where(F.col("event_type") != "signup")
    return topics.merge(events, again).dropDuplicates(["event_id"])


@query("""
WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT event_id, CASE WHEN e.ts <= v.ts + INTERVAL 2 DAY THEN v.ts END AS since, CASE WHEN e.ts <= v.ts + INTERVAL 2 DAY THEN v.value END AS last_value
FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE event_type <> 'purchase'
""")
def lookup_as_of(t: Tables):
    # Each event meets the user's last purchase, unless that is more than two days old.
    bought = t.events.where(F.col("event_type") == "purchase").select("user_id", "ts", "value")
    others = t.events.where(F.col("event_type") != "purchase").select("event_id", "user_id", "ts")
    found = versions.as_of(others, bought, ["user_id"], "ts", "ts", ttl=timedelta(days=2))
    return found.select("event_id", F.col("version.ts").alias("since"), F.col("version.value").alias("last_value"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> 'click'")
def custom_target(t: Tables):
    custom.register(t.spark, targets.ManifestTarget)
    rows = t.events.where(F.col("event_type") != "click").select("event_id", "event_type", "value")
    path = f"{shared_folder(t.spark).rstrip('/')}/targets/{uuid.uuid4().hex}"
    for _ in range(2):  # a repeated batch adds nothing
        rows.write.format("manifest").option("path", path).option("batch", "one").mode("append").save()
    return targets.committed(t.spark, path, rows.schema)
