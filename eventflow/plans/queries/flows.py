"""Agents put together: chains, fan-in, fallbacks, subworkflows, and the flagship flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.functions import json_text
from eventflow.operators import flow, redelivery, validate
from eventflow.operators.normalize import features
from eventflow.operators.redelivery import Policy
from eventflow.operators.throttle import throttle
from eventflow.operators.validate import FieldRule, Rules
from eventflow.plans.cases import case_workflow
from eventflow.plans.fraud import fraud_detection
from eventflow.plans.registry import Tables, query
from eventflow.plans.sentiment import sentiment
from eventflow.sources.context import lookup

from .common import BODY, MESSAGES_SQL, messages
from .prompts import load_echo

_FLAGSHIP_SQL = """
SELECT event_id, value, CAST(hour(ts) AS BIGINT) AS tx_hour, value > 100 AS is_high_value,
       round(1 / (1 + exp(-(0.02 * value + 0.05 * hour(ts) + CASE WHEN value > 100 THEN 1.5 ELSE 0 END - 3))), 6) AS risk_score,
       CASE WHEN round(1 / (1 + exp(-(0.02 * value + 0.05 * hour(ts) + CASE WHEN value > 100 THEN 1.5 ELSE 0 END - 3))), 6) >= 0.8 THEN 'alerts.high_risk'
            WHEN round(1 / (1 + exp(-(0.02 * value + 0.05 * hour(ts) + CASE WHEN value > 100 THEN 1.5 ELSE 0 END - 3))), 6) >= 0.6 THEN 'alerts.medium_risk'
            ELSE 'transactions.processed' END AS topic
FROM events WHERE event_type <> 'error'
UNION ALL
SELECT event_id, value, -1, false, -1, 'transactions.errors' FROM events WHERE event_type = 'error'
"""


@query(_FLAGSHIP_SQL)
def fraud_flow(t: Tables):
    # Rejected events have no features; the fill keeps NULLs out of the comparison.
    return fraud_detection(t.events).na.fill({"tx_hour": -1, "is_high_value": False, "risk_score": -1.0})


@query(r"""
WITH c AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}\s]', '', 'g') AS text FROM documents),
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM c),
     s AS (SELECT doc_id, coalesce(round(len(list_distinct(words)) / nullif(len(words), 0), 6), 0.0) AS score FROM w)
SELECT doc_id, score, CASE WHEN score > 0.8 THEN 'alerts.high_sentiment' ELSE 'analysis.results' END AS topic FROM s
""")
def sentiment_flow(t: Tables):
    return sentiment(t.documents.select("doc_id", "text")).select("doc_id", "score", "topic")


@query("""
WITH m AS (SELECT lang, median(n_chars) AS med FROM documents GROUP BY 1),
     a AS (SELECT d.lang, median(abs(d.n_chars - m.med)) AS mad FROM documents d JOIN m ON m.lang = d.lang GROUP BY 1),
     z AS (SELECT d.doc_id, d.lang, d.n_chars, l.toxic = 1 AS toxic, abs(d.n_chars - m.med) / a.mad > 3.0 AS outlier
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN m ON m.lang = d.lang JOIN a ON a.lang = d.lang),
     u AS (SELECT *, CASE WHEN outlier AND toxic THEN 'critical' WHEN outlier OR toxic THEN 'high' ELSE 'low' END AS urgency FROM z),
     p AS (SELECT *, 'Analyze case ' || doc_id || ' in ' || lang || '.' || chr(10) || 'Urgency: ' || urgency ||
                  CASE WHEN outlier THEN chr(10) || 'Note: unusual length' ELSE '' END AS prompt FROM u)
SELECT doc_id, urgency, length(prompt) || ':' || md5(prompt) AS analysis,
       CASE WHEN n_chars > 20000 THEN 'alerts.invalid_output' WHEN urgency = 'critical' THEN 'alerts.critical'
            WHEN urgency = 'high' THEN 'alerts.warning' ELSE 'updates' END AS topic
FROM p
""")
def case_flow(t: Tables):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    return case_workflow(load_echo).run(source=docs, labels=t.labels)["routed"].select("doc_id", "urgency", "analysis", "topic")


@query("""
SELECT doc_id, l.quality, l.toxic, d.lang FROM documents d JOIN labels l USING (doc_id)
""")
def fan_in_join(t: Tables):
    joined = flow.fan_in({"text": t.documents.select("doc_id", "lang"), "label": t.labels}, ["doc_id"])
    return joined.select("doc_id", "label.quality", "label.toxic", "text.lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fan_in_unmatched(t: Tables):
    return flow.unmatched(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("""
SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
""")
def context_lookup(t: Tables):
    customers = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    found = lookup(t.orders.select("o_orderkey", "o_custkey"), customers, ["o_custkey"])
    return lookup(found, nations, ["c_nationkey"]).select("o_orderkey", "c_mktsegment", "n_name")


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def fallback_merge(t: Tables):
    unknown = t.documents.select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return flow.merge_back(unknown, t.labels, ["doc_id"], ["quality", "toxic"])


@query(f"""
WITH m AS ({MESSAGES_SQL})
SELECT message_id, CAST(regexp_extract(payload, '[0-9]+') AS BIGINT) AS k,
       CASE WHEN json_valid(payload) THEN 'primary' ELSE 'fallback' END AS handled_by
FROM m
""")
def fallback_agent(t: Tables):
    decoded = json_text.decode(messages(t.events), BODY).withColumn("k", F.col("body.k"))

    salvaged = F.regexp_extract("payload", "[0-9]+", 0).cast("bigint")
    done = flow.with_fallback(decoded, F.col("decode_error").isNotNull(), {"k": salvaged})
    return done.select("message_id", "k", "handled_by")


@query("""
SELECT event_id, CAST(hour(ts) AS BIGINT) AS tx_hour, round(value * 1.1, 6) AS gross, value > 100 AS is_high_value
FROM events WHERE event_type <> 'error'
""")
def agent_chain(t: Tables):
    def accepted(df):
        rules = Rules({"event_type": FieldRule(required=True, allowed_values=("view", "click", "purchase", "signup"))})
        return validate.split(validate.validate(df, rules))[0]

    return flow.chain(
        t.events,
        accepted,
        lambda df: features(df, ["value", "tx_hour", "is_high_value: value > 100"], keep=["event_id"]),
        lambda df: df.select("event_id", "tx_hour", F.round(F.col("value") * 1.1, 6).alias("gross"), "is_high_value"),
    )


@query("""
SELECT o_orderkey AS alert_id, round(o_totalprice / 500000, 8) AS alert_score,
       CASE WHEN c_acctbal < 0 THEN 'indebted' ELSE 'sound' END AS alert_factor
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def subworkflow_map(t: Tables):
    def assess_risk(transaction_data, customer_history):
        joined = transaction_data.join(customer_history, on="customer")
        factor = F.when(F.col("balance") < 0, "indebted").otherwise("sound")
        scored = joined.select("id", F.round(F.col("amount") / 500000, 8).alias("risk_score"), factor.alias("risk_factor"))
        return {"risk": scored}

    inputs = {
        "transaction_data": (t.orders, {"o_orderkey": "id", "o_custkey": "customer", "o_totalprice": "amount"}),
        "customer_history": (t.customer, {"c_custkey": "customer", "c_acctbal": "balance"}),
    }
    outputs = {"risk": {"id": "alert_id", "risk_score": "alert_score", "risk_factor": "alert_factor"}}
    return flow.subworkflow(assess_risk, inputs, outputs)["risk"]


@query(f"""
WITH m AS ({MESSAGES_SQL})
SELECT 'decoder' AS agent, message_id, 'invalid JSON payload' AS error FROM m WHERE NOT json_valid(payload)
UNION ALL
SELECT 'validator', message_id, 'Missing required field: reply_to' FROM m WHERE reply_to IS NULL
""")
def error_union(t: Tables):
    decoded = json_text.decode(messages(t.events), BODY)
    checked = validate.validate(decoded, Rules({"reply_to": FieldRule(required=True)}))
    invalid = F.when(~validate.is_valid(), validate.messages())
    return flow.errors_of(checked, "message_id", {"decoder": F.col("decode_error"), "validator": invalid})


@query("""
SELECT o_orderpriority, CASE WHEN l_shipdate - o_orderdate <= INTERVAL 60 DAY THEN 'ok' ELSE 'timed_out' END AS status, count(*) AS n
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def step_timeout(t: Tables):
    started = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderdate")
    ended = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_shipdate")
    status = flow.step_status(F.col("o_orderdate"), F.col("l_shipdate"), 60 * 86400)
    return started.join(ended, on="id").groupBy("o_orderpriority", status.alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE pass AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL
  SELECT p.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = p.user_id AND e.ts > p.ts + INTERVAL 1 DAY)
  FROM pass p WHERE p.ts IS NOT NULL)
SELECT e.event_id, e.user_id, e.ts FROM events e JOIN pass p ON p.user_id = e.user_id AND p.ts = e.ts
""")
def ttl_throttle(t: Tables):
    events = t.events.select("event_id", "user_id", "ts")
    return throttle(events, "user_id", "ts", F.date_trunc("WEEK", "ts"), 86400, tie="event_id")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'greet' ELSE lang END AS action, CASE WHEN quality IS NOT NULL THEN source END AS name
           FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN action = 'greet' THEN 'Hello, ' || coalesce(name, 'stranger') || '!' END AS message,
       CASE WHEN action <> 'greet' THEN 'Unknown action: ' || action END AS error
FROM d
""")
def action_dispatch(t: Tables):
    docs = t.documents.select("doc_id", "lang", "source").join(t.labels, on="doc_id", how="left")
    asked = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", "greet").otherwise(F.col("lang")).alias("action"),
        F.when(F.col("quality").isNotNull(), F.col("source")).alias("name"),
    )
    greeting = F.concat(F.lit("Hello, "), F.coalesce("name", F.lit("stranger")), F.lit("!"))
    is_greet = F.col("action") == "greet"
    return asked.select(
        "doc_id",
        F.when(is_greet, greeting).alias("message"),
        F.when(~is_greet, F.concat(F.lit("Unknown action: "), "action")).alias("error"),
    )


def _redelivery_sql(days: int, pauses: list[int]) -> str:
    """Each try ends with its first answer in time, or with its limit; failed ones are followed by a pause and the next try."""
    parts = [
        """answer AS (
  SELECT l_orderkey AS id, l_shipdate AS ts, CASE l_returnflag WHEN 'A' THEN 'result' ELSE 'failure' END AS kind, l_returnflag AS flag
  FROM lineitem WHERE l_returnflag <> 'N')""",
        "try_1 AS (SELECT o_orderkey AS id, 1 AS attempt, o_orderdate AS started FROM orders)",
    ]
    for n in range(1, len(pauses) + 2):
        limit = f"started + INTERVAL {days} DAY"
        parts.append(f"""end_{n} AS (
  SELECT t.id, t.attempt, t.started, arg_min(a.kind, (a.ts, a.flag)) AS kind, coalesce(min(a.ts), t.{limit}) AS ended
  FROM try_{n} t LEFT JOIN answer a ON a.id = t.id AND a.ts BETWEEN t.started AND t.{limit} GROUP BY t.id, t.attempt, t.started)""")
        if n <= len(pauses):
            parts.append(f"""try_{n + 1} AS (
  SELECT id, {n + 1} AS attempt, ended + INTERVAL {pauses[n - 1]} DAY AS started FROM end_{n} WHERE kind IS DISTINCT FROM 'result')""")
    ends = " UNION ALL ".join(f"SELECT * FROM end_{n}" for n in range(1, len(pauses) + 2))
    again = " UNION ALL ".join(f"SELECT id, 'deliver', attempt, started, NULL FROM try_{n}" for n in range(2, len(pauses) + 2))
    return f"""
WITH {", ".join(parts)}
SELECT id, CASE WHEN kind = 'result' THEN 'ok' WHEN attempt <= {len(pauses)} THEN 'retry' ELSE 'given_up' END AS status,
       CAST(attempt AS BIGINT) AS attempt, ended AS "at", CASE WHEN kind IS DISTINCT FROM 'result' THEN coalesce(kind, 'timed_out') END AS reason
FROM ({ends}) UNION ALL {again}
"""


@query(_redelivery_sql(20, [5, 10]))
def step_redelivery(t: Tables):
    # An order asks for its delivery; accepted lines answer it, returned ones are failures, others say nothing.
    asked = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("request").alias("kind"), F.col("o_orderdate").alias("ts"), F.lit("").alias("payload"))
    kind = F.when(F.col("l_returnflag") == "A", "result").otherwise("failure")
    answers = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("id"), kind.alias("kind"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("payload"))
    policy = Policy(timeout_seconds=20 * 86400, retries=2, delay_seconds=5 * 86400, longest_seconds=30 * 86400)
    done = redelivery.outcomes(asked.unionByName(answers), policy)
    return done.where(F.col("status").isin("ok", "retry", "deliver", "given_up")).select(
        "id", "status", "attempt", F.col("at").cast("timestamp_ntz").alias("at"), "reason"
    )
