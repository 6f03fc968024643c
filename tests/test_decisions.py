"""Rules, checks, routes and actions."""

import json

from pyspark.sql import functions as F

from eventflow.operators import decide as d
from eventflow.operators import route as r
from eventflow.operators.decide import Check, Rule
from eventflow.operators.route import Action, Route

PARCELS = [("express", 12.5), ("express", 2.0), (None, None)]
EXPRESS = {"op": "regex", "field": "service", "pattern": "^exp"}
HEAVY = {"op": "gt", "field": "kilos", "value": 10}


def parcels(spark):
    return spark.createDataFrame(PARCELS, "service string, kilos double")


def decisions(df, rules, **options):
    return [x.decision for x in d.decide(df, rules, **options).collect()]


def test_all_conditions_must_hold(spark):
    van = Rule("van", "by van", (EXPRESS, HEAVY), priority=1)
    assert decisions(parcels(spark), [van]) == ["by van", "unknown", "unknown"]
    assert decisions(parcels(spark), [van], default="by bike") == ["by van", "by bike", "by bike"]
    assert decisions(parcels(spark), []) == ["unknown"] * 3


def test_equal_priorities_keep_their_order(spark):
    rules = [Rule("last", "z", priority=-3), Rule("fast", "y", (EXPRESS,), 7), Rule("any", "x", (), 7)]
    df = parcels(spark)
    assert decisions(df, rules) == ["y", "y", "x"]
    ids = [x[0] for x in df.select(d.matching_rules(rules, df.schema)).collect()]
    assert ids == [["fast", "any", "last"], ["fast", "any", "last"], ["any", "last"]]


def test_thousands_of_rules_and_routes(spark):
    rules = [Rule(f"r{i}", f"d{i}", ({"op": "eq", "field": "x", "value": i},), priority=-i) for i in range(2000)]
    df = spark.createDataFrame([(0,), (1999,), (5000,)], "x int")
    assert [x.decision for x in d.decide(df, rules).orderBy("x").collect()] == ["d0", "d1999", "unknown"]
    pairs = [(f"x = {i}", f"t{i}") for i in range(2000)]
    assert [x.t for x in df.select("x", r.route_by_rules(pairs, "none").alias("t")).orderBy("x").collect()] == ["t0", "t1999", "none"]


def test_load_rules():
    text = json.dumps([{"id": "van", "priority": 4, "conditions": [HEAVY, EXPRESS], "decision": "by van"}])
    assert d.load_rules(text) == [Rule("van", "by van", (HEAVY, EXPRESS), 4)]


def test_rules_table(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 50), (3, "b", 50), (4, None, 9)], "id int, kind string, x int")
    rules = spark.createDataFrame(
        [("a", 1, 0, 0, "any"), ("a", 9, 1, 40, "big"), ("a", 9, 2, 40, "later")], "kind string, priority int, ord int, bound int, decision string"
    )
    out = d.decide_by_table(rows, rules, ["kind"], lambda rule: F.col("x") > rule["bound"])
    assert {x.id: x.decision for x in out.collect()} == {1: "any", 2: "big", 3: "unknown", 4: "unknown"}


def test_checks_and_failure_route(spark):
    checks = [Check("service", "service LIKE 'e%'", "no such service"), Check("weight", "kilos >= 10", "too light")]
    failed = [[f["name"] for f in x[0]] for x in parcels(spark).select(d.failed_checks(checks)).collect()]
    assert failed == [[], ["weight"], ["service", "weight"]]
    attempts = spark.createDataFrame([(False, 9), (True, 1), (True, 2), (True, 3)], "bad boolean, n int")
    topic = d.failure_route(F.col("bad"), F.col("n"), 2, "ok", "again", "reject")
    assert [x[0] for x in attempts.select(topic).collect()] == ["ok", "again", "again", "reject"]


SWITCH = json.dumps(
    [
        {"id": "closed", "description": "", "pattern": "", "actions": [], "priority": 80, "enabled": False},
        {"id": "broken", "description": "", "pattern": "a(", "actions": [], "priority": 70},
        {
            "id": "invoices",
            "description": "bills go to the desk",
            "pattern": "^(invoice|bill) ",
            "actions": [{"type": "publish", "target": "desk"}, {"type": "log", "message": "billed"}],
            "priority": 60,
        },
    ]
)


def test_load_routes(spark):
    routes = r.load_routes(SWITCH)
    assert [x.id for x in r.usable(routes)] == ["invoices"]
    publish, log = routes[2].actions
    assert (publish.type, publish.timeout_secs, log.type, log.level) == ("publish", 30, "log", "info")


def run(spark, payloads, routes, **options):
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    rows = r.route(df, routes, **options).orderBy("payload", "action_no").collect()
    return [(x.payload, x.action_no, x.action.type, x.action.target or x.action.message) for x in rows]


def test_first_match_default_and_multicast(spark):
    copies = Route("copies", "", (Action("publish", target="archive"),), priority=5)
    routes = [*r.load_routes(SWITCH), copies]
    desk = [("bill 7", 0, "publish", "desk"), ("bill 7", 1, "log", "billed")]
    assert run(spark, ["bill 7"], routes) == desk
    assert run(spark, ["bill 7"], routes, stop_after_first_match=False) == [*desk, ("bill 7", 2, "publish", "archive")]
    assert run(spark, ["letter"], routes) == [("letter", 0, "publish", "archive")]
    for few in (routes[:3], []):
        assert run(spark, ["letter"], few) == [("letter", 0, "log", "No matching route found")]


def test_transform_ends_the_list_only_in_compat(spark):
    acts = Action("publish", target="a"), Action("transform", script="upper(payload)", target="b"), Action("publish", target="c")
    routes = [Route("x", "m", acts, conditions=("true",))]
    df = spark.createDataFrame([("msg",)], "payload string")

    def sent(**options):
        return [(x.topic, x.payload) for x in r.deliveries(r.route(df, routes, **options), routes).orderBy("topic").collect()]

    assert sent() == [("a", "msg"), ("b", "MSG"), ("c", "msg")]
    assert sent(compat=True) == [("a", "msg")]


def test_forward_merges_headers(spark):
    routes = [Route("x", "", (Action("forward", target="t", headers={"a": "2"}),))]
    df = spark.sql("SELECT 'm' AS payload, map('a', '1', 'b', '1') AS headers")
    assert r.deliveries(r.route(df, routes), routes, headers="headers").first().out_headers == {"a": "2", "b": "1"}


def test_route_by_rules_order_and_nulls(spark):
    topic = r.route_by_rules([("kilos > 10", "crane"), ("kilos > 1", "belt")], "desk")
    assert [x[0] for x in parcels(spark).select(topic).collect()] == ["crane", "belt", "desk"]
