"""Composition, checks, workflows."""

import pytest
from pyspark.sql import functions as F

from eventflow.operators import checks, flow, metrics
from eventflow.plans.fraud import fraud_detection
from eventflow.plans.workflow import Workflow, to_targets


def numbers(spark, n=6):
    return spark.range(n).select("id", (F.col("id") * 10).alias("v"))


def test_guard_keeps_the_others(spark):
    out = flow.guarded(numbers(spark), "v > 30", lambda df: df.withColumn("v", -F.col("v")))
    assert sorted(r.v for r in out.collect()) == [-50, -40, 0, 10, 20, 30]


def test_guard_and_fallback_as_columns(spark):
    out = flow.guarded(numbers(spark), "v > 30", {"v": -F.col("v"), "note": F.lit("big")})
    assert sorted((r.v, r.note) for r in out.collect() if r.note) == [(-50, "big"), (-40, "big")]
    out = flow.with_fallback(numbers(spark, 3), F.col("v") == 10, {"v": F.lit(-1).cast("long")})
    assert {(r.id, r.v, r.handled_by) for r in out.collect()} == {(0, 0, "primary"), (2, 20, "primary"), (1, -1, "fallback")}


def test_custom_agent(spark):
    def greet(pdf):
        ok = pdf["action"] == "greet"
        message = "Hello, " + pdf["name"].fillna("stranger") + "!"
        return pdf.assign(message=message.where(ok, None), error=(~ok).map({True: "unknown action", False: None}))

    df = spark.createDataFrame([("greet", "Ann"), ("greet", None), ("dance", "Bob")], "action string, name string")
    rows = flow.custom(df, greet, "action string, name string, message string, error string").collect()
    assert [(r.message, r.error) for r in rows] == [("Hello, Ann!", None), ("Hello, stranger!", None), (None, "unknown action")]


def test_errors_of_several_agents(spark):
    df = numbers(spark, 3)
    errors = {"a": F.when(F.col("v") > 0, F.lit("positive")), "b": F.when(F.col("v") == 20, F.lit("twenty"))}
    expected = {("a", 1, "positive"), ("a", 2, "positive"), ("b", 2, "twenty")}
    assert {tuple(r) for r in flow.errors_of(df, "id", errors).collect()} == expected
    steps = {agent: df.withColumn("error", e) for agent, e in errors.items()}
    assert {tuple(r) for r in flow.collect_errors(steps, "id").collect()} == expected


def test_fan_in_and_unmatched(spark):
    left, right = numbers(spark, 4), numbers(spark, 6).where("id > 2").withColumnRenamed("v", "w")
    rows = flow.fan_in({"a": left, "b": right}, ["id"]).collect()
    assert [(r.id, r.a.v, r.b.w) for r in rows] == [(3, 30, 30)]
    assert sorted(r.id for r in flow.unmatched(left, right, ["id"]).collect()) == [0, 1, 2]


def test_merge_back(spark):
    reviewed = spark.createDataFrame([(1, 99), (2, None)], "id long, v long")
    out = flow.merge_back(numbers(spark, 4), reviewed, ["id"], ["v"]).orderBy("id").collect()
    assert [r.v for r in out] == [0, 99, 20, 30]


def test_fallback(spark):
    out = flow.with_fallback(numbers(spark, 3), F.col("v") == 10, lambda df: df.withColumn("v", F.lit(-1).cast("long")))
    assert {(r.id, r.v, r.handled_by) for r in out.collect()} == {(0, 0, "primary"), (2, 20, "primary"), (1, -1, "fallback")}


def test_subworkflow_sees_mapped_columns_only(spark):
    def body(part):
        assert part.columns == ["x"]
        return {"out": part.withColumn("y", F.col("x") + 1)}

    got = flow.subworkflow(body, {"part": (numbers(spark, 2), {"v": "x"})}, {"out": {"y": "score"}})
    assert sorted(r.score for r in got["out"].collect()) == [1, 11]


def test_step_status(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp'2024-01-01 00:00:10', timestamp'2024-01-01 00:00:11', NULL)) AS e, timestamp'2024-01-01' AS s"
    )
    assert [r[0] for r in df.select(flow.step_status(F.col("s"), F.col("e"), 10)).collect()] == ["ok", "timed_out", "timed_out"]


def test_catalogue_checks(spark):
    agents = spark.createDataFrame(
        [
            ("wf", "a1", "llm", {"model": "x"}),
            ("wf", "a1", "mlmodel", {"model_name": "m"}),
            ("wf", None, "llm", {}),
            ("sub", "1bad", "mlmodel", {}),
            ("empty", "ok", "router", {}),
        ],
        "scope string, agent_id string, kind string, config map<string,string>",
    )
    config, kind, name = F.col("config"), F.col("kind"), F.col("agent_id")
    rules = {
        "missing id": name.isNull(),
        "bad identifier": name.isNotNull() & ~checks.is_identifier(name),
        "missing model": (kind == "llm") & checks.lacks_any(config, ["model"]),
        "missing model file": (kind == "mlmodel") & checks.lacks_any(config, ["model_path", "model_name"]),
    }
    report = checks.report(agents, checks.error_rows(agents, "scope", rules))
    rows = {r.scope: (r.valid, r.error_count, r.errors) for r in report.collect()}
    assert rows["empty"] == (True, 0, [])
    assert rows["wf"] == (False, 2, ["missing id x1", "missing model x1"])
    assert rows["sub"] == (False, 2, ["bad identifier x1", "missing model file x1"])
    assert [(r.agent_id, r.n) for r in checks.duplicates(agents.select("agent_id")).collect()] == [("a1", 2)]
    counts = {r.kind: r.n for r in checks.count_by(agents, "kind").collect()}
    assert counts == {"llm": 2, "mlmodel": 2, "router": 1}


def test_blank(spark):
    df = spark.createDataFrame([("",), (" \t\n",), (None,), ("x ",)], "t string")
    assert [r[0] for r in df.select(checks.is_blank(F.col("t"))).collect()] == [True, True, True, False]


def test_progress(spark):
    df = numbers(spark, 6).withColumn("k", F.lit(1))
    assert metrics.progress(df, ["k"], F.col("v") < 20).first().progress == "2/6 completed (33%)"


def workflow():
    return (
        Workflow("Demo", preprocessors=[lambda df: df.where("id < 5")])
        .agent("double", lambda df: df.withColumn("v", F.col("v") * 2))
        .agent("big", lambda df: df, when="v > 20")
        .agent("merge", lambda a, b: a.join(b.select("id"), "id", "left_anti"), "double", "big")
    )


def test_workflow(spark):
    out = workflow().run(source=numbers(spark, 8))
    assert sorted(r.v for r in out["big"].collect()) == [40, 60, 80]
    assert sorted(r.v for r in out["merge"].collect()) == [0, 20]


def test_workflow_problems():
    assert Workflow("ok").problems(["source"]) == []
    assert Workflow("1x").problems([]) == ["'1x' is not an identifier", "a workflow needs a source"]
    bad = Workflow("w").agent("a", lambda d: d).agent("a", lambda d: d, "nowhere").agent("", lambda d: d, "a")
    assert bad.problems(["source"]) == [
        "duplicate agent id: a",
        "agent a reads unknown input nowhere",
        "every agent needs an id",
    ]
    with pytest.raises(ValueError):
        bad.run()


def test_targets(spark, data):
    routed = fraud_detection(spark.read.parquet(f"{data}/events.parquet"))
    parts = to_targets(routed, ["alerts.high_risk", "alerts.medium_risk", "transactions.processed", "transactions.errors"])
    assert sum(p.count() for p in parts.values()) == routed.count()
