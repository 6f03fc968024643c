"""Routers: patterns, priorities, multicast and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import route as r
from eventflow.operators import route_index
from eventflow.operators.route import Action, Route
from eventflow.plans.registry import Tables, query

# The message text a router searches: type and payload in one JSON document.
_TEXT_SQL = """'{"type":"' || event_type || '","data":' || props || '}'"""


def texts(t: Tables):
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","data":'), "props", F.lit("}"))
    return t.events.select("event_id", "user_id", "event_type", "value", text.alias("payload"))


def _publish(target):
    return Action("publish", target=target)


ROUTES = [
    Route("nines", '"k": 9', (_publish("nines"),), priority=1),
    Route("money", "purchase|signup", (_publish("sales"), Action("log", message="sale", level="debug")), priority=7),
    Route("off", ".*", (_publish("never"),), priority=99, enabled=False),
    Route("broken", "([", (_publish("never"),), priority=98),
    Route("faults", "error", (_publish("ops"),), conditions=("value > 40",), priority=7),
]


@query("""
SELECT event_id, CASE WHEN value >= 150 THEN 'alerts.high_risk' WHEN value >= 80 OR event_type = 'error' THEN 'alerts.medium_risk'
                      ELSE 'processed' END AS topic
FROM events
""")
def route_rules(t: Tables):
    rules = [("value >= 150", "alerts.high_risk"), ("value >= 80 OR event_type = 'error'", "alerts.medium_risk")]
    return t.events.select("event_id", r.route_by_rules(rules, "processed").alias("topic"))


@query(f"""
WITH m AS (SELECT event_id, {_TEXT_SQL} AS payload FROM events)
SELECT event_id, regexp_matches(payload, 'purchase|"k": 1') AS hit, false AS broken FROM m
""")
def route_regex(t: Tables):
    messages = texts(t)
    hit = r.route_matches(Route("x", 'purchase|"k": 1', ()), F.col("payload"))
    broken = r.route_matches(Route("y", "([", ()), F.col("payload"))
    return messages.select("event_id", hit.alias("hit"), broken.alias("broken"))


@query("SELECT event_id, event_type = 'error' AND value > 40 AND user_id < 75 AS hit FROM events")
def route_conditions(t: Tables):
    route = Route("x", "error", (), conditions=("value > 40", "user_id < 75"))
    return texts(t).select("event_id", r.route_matches(route, F.col("payload")).alias("hit"))


@query("SELECT event_id, event_type = 'error' AS with_conditions, true AS without_conditions FROM events")
def route_compat(t: Tables):
    payload = F.col("payload")
    strict = Route("x", "error", (), conditions=("value > 40",))
    free = Route("y", "error", ())
    return texts(t).select(
        "event_id",
        r.route_matches(strict, payload, compat=True).alias("with_conditions"),
        r.route_matches(free, payload, compat=True).alias("without_conditions"),
    )


_FIRST_SQL = f"""
SELECT event_id, value, CASE WHEN regexp_matches(payload, 'purchase|signup') THEN 'money'
    WHEN regexp_matches(payload, 'error') AND value > 40 THEN 'faults'
    WHEN regexp_matches(payload, '"k": 9') THEN 'nines' ELSE 'none' END AS route
FROM (SELECT event_id, value, {_TEXT_SQL} AS payload FROM events)
"""


@query(f"""
WITH f AS ({_FIRST_SQL})
SELECT event_id, 0 AS action_no,
       CASE route WHEN 'money' THEN 'sales' WHEN 'faults' THEN 'ops' WHEN 'nines' THEN 'nines' ELSE 'log:No matching route found' END AS target FROM f
UNION ALL
SELECT event_id, 1, 'log:sale' FROM f WHERE route = 'money'
""")
def route_priority(t: Tables):
    routed = r.route(texts(t), ROUTES)
    target = F.coalesce(F.col("action.target"), F.concat(F.lit("log:"), F.col("action.message")))
    return routed.select("event_id", "action_no", target.alias("target"))


_ALL_SQL = f"""
SELECT event_id, hit.target AS target, hit.p AS p FROM (
  SELECT event_id, unnest(list_filter([
     CASE WHEN regexp_matches(payload, 'purchase|signup') THEN {{'target': 'sales', 'p': 1}} END,
     CASE WHEN regexp_matches(payload, 'purchase|signup') THEN {{'target': 'log:sale', 'p': 2}} END,
     CASE WHEN regexp_matches(payload, 'error') AND value > 40 THEN {{'target': 'ops', 'p': 3}} END,
     CASE WHEN regexp_matches(payload, '"k": 9') THEN {{'target': 'nines', 'p': 4}} END], lambda x: x IS NOT NULL)) AS hit
  FROM (SELECT event_id, value, {_TEXT_SQL} AS payload FROM events))
"""


@query(f"""
WITH a AS ({_ALL_SQL})
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY p) - 1 AS action_no, target FROM a
UNION ALL
SELECT event_id, 0, 'log:No matching route found' FROM events WHERE event_id NOT IN (SELECT event_id FROM a)
""")
def route_multicast(t: Tables):
    routed = r.route(texts(t), ROUTES, stop_after_first_match=False)
    target = F.coalesce(F.col("action.target"), F.concat(F.lit("log:"), F.col("action.message")))
    return routed.select("event_id", "action_no", target.alias("target"))


@query(f"""
WITH f AS ({_FIRST_SQL})
SELECT event_id, 'log' AS type, 'No matching route found' AS message, 'warn' AS level FROM f WHERE route = 'none'
""")
def route_default(t: Tables):
    routed = r.route(texts(t), [x for x in ROUTES if x.id != "off"])
    return routed.where(F.col("action.message") == r.NO_ROUTE).select(
        "event_id", "action.type", "action.message", "action.level"
    )


SENDING = [
    Route("sale", "purchase", (_publish("sales"), Action("forward", target="crm", headers={"via": "router"})), priority=2),
    Route("view", "view", (Action("publish", target="views", transform="concat('view of ', user_id)"),)),
]


@query(f"""
WITH m AS (SELECT event_id, user_id, event_type, {_TEXT_SQL} AS payload FROM events)
SELECT event_id, 'sales' AS topic, payload, 'none' AS via FROM m WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'crm', payload, 'router' FROM m WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'views', 'view of ' || user_id, 'none' FROM m WHERE event_type = 'view'
""")
def route_actions(t: Tables):
    sent = r.deliveries(r.route(texts(t), SENDING), SENDING)
    via = F.coalesce(F.try_element_at("out_headers", F.lit("via")), F.lit("none"))
    return sent.select("event_id", "topic", "payload", via.alias("via"))


@query("""
SELECT event_id, 'error' AS level, 'fault seen' AS message FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'info', 'odd level' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'warn', 'No matching route found' FROM events WHERE event_type <> 'error'
""")
def route_log(t: Tables):
    logging = Action("log", message="fault seen", level="error"), Action("log", message="odd level", level="loud")
    routed = r.route(texts(t), [Route("f", "error", logging)])
    return r.log_lines(routed).select("event_id", "level", "message")


@query("""
SELECT event_id, 'amounts' AS topic, 'user ' || user_id AS payload, 'intended' AS mode FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'copies', 'same', 'intended' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'first', 'same', 'intended' FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id, 'first', 'same', 'compat' FROM events WHERE event_type = 'purchase'
""")
def route_transform(t: Tables):
    steps = _publish("first"), Action("transform", target="amounts", script="concat('user ', user_id)"), _publish("copies")
    routes = [Route("p", "purchase", steps, conditions=("true",))]
    found = texts(t).withColumn("payload", F.col("event_type"))

    def sent(compat: bool, mode: str):
        done = r.deliveries(r.route(found, routes, compat=compat), routes)
        shown = F.when(F.col("payload") == F.col("event_type"), "same").otherwise(F.col("payload"))
        return done.select("event_id", "topic", shown.alias("payload"), F.lit(mode).alias("mode"))

    return sent(False, "intended").unionByName(sent(True, "compat"))


@query(f"""
WITH a AS ({_ALL_SQL}), c AS (SELECT event_id, count(*) AS n FROM a GROUP BY 1)
SELECT e.event_id, 'routed' AS status, coalesce(c.n, 1) AS actions FROM events e LEFT JOIN c ON c.event_id = e.event_id
""")
def route_action_count(t: Tables):
    actions = r.actions_of(ROUTES, F.col("payload"), stop_after_first_match=False)
    return texts(t).select("event_id", F.lit("routed").alias("status"), F.size(actions).cast("bigint").alias("actions"))


@query("""
SELECT c_custkey, coalesce('desk.' || r_name, 'desk.other') AS topic
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 5 LEFT JOIN region ON r_regionkey = n_regionkey
""")
def route_lookup(t: Tables):
    desks = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("desk."), "r_name").alias("desk")
    )
    # Keys moved on by five, so that the last customers belong to no known nation.
    customers = t.customer.select("c_custkey", (F.col("c_nationkey") + 5).alias("c_nationkey"))
    return r.route_by_lookup(customers, desks, ["c_nationkey"], "desk", "desk.other").drop("c_nationkey")


@query("""
WITH r AS (SELECT c_custkey AS id, c_nationkey AS nation, c_custkey // 10 AS k, c_custkey % 3 = 0 AS errors,
                  c_custkey - (c_custkey % 7) * 1000000000 AS place FROM customer),
     e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, count(id) AS n_routes, CAST(arg_min(id, place) AS VARCHAR) AS route_id,
       coalesce('nation.' || arg_min(nation, place), 'unrouted') AS topic
FROM e LEFT JOIN r ON r.k = e.k AND (NOT errors OR event_type = 'error') GROUP BY event_id
""")
def route_table(t: Tables):
    # A route per customer: ten share a number, every third takes errors only.
    number = F.floor(F.col("c_custkey") / 10).cast("string")
    pattern = F.concat(F.when(F.col("c_custkey") % 3 == 0, "error.*").otherwise(""), F.lit('"k": '), number, F.lit("\\D"))
    target = F.concat(F.lit("nation."), F.col("c_nationkey").cast("string"))
    table = t.customer.select(
        F.col("c_custkey").alias("route_id"), pattern.alias("pattern"), target.alias("target"),
        (F.col("c_custkey") % 7).alias("priority"), F.col("c_custkey").alias("ord"),
    )
    found = route_index.matching(texts(t), route_index.stored(table))
    best = F.try_element_at("routes", F.lit(1))
    topic = F.coalesce(best["target"], F.lit("unrouted"))
    return found.select("event_id", F.size("routes").cast("bigint").alias("n_routes"), best["route_id"].alias("route_id"), topic.alias("topic"))
