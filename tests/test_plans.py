"""What the plans look like: no Python where columns suffice, pruned scans, no needless joins."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from eventflow.operators import review, score
from eventflow.operators.review import ReviewConfig
from eventflow.plans.registry import QUERIES
from eventflow.sources import context

# Queries whose point is user-supplied Python, or that follow a message event by event or work on arrays of a network.
PYTHON = {"python_rule", "ml_score", "ml_format", "ml_threshold", "ml_error_split", "llm_generate", "llm_error_split", "llm_time_limit", "route_table", "ttl_throttle", "case_flow",
          "step_redelivery", "bayes_missing_evidence"}
NARROW = ["fraud_flow", "decide", "decide_priority", "validation_errors", "error_route", "route_multicast", "text_clean", "features",
          "json_decode", "route_actions", "llm_request", "ml_linear", "pubsub_fanout", "reply_fanout", "cond_tree", "decision_reply", "guard_filter", "fallback_agent", "error_union"]


def plan(spark, data, name):
    return entry_points.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_stays_on_the_jvm_without_cross_joins(spark, data, name):
    text = plan(spark, data, name)
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


@pytest.mark.parametrize("name", NARROW)
def test_does_not_shuffle(spark, data, name):
    assert "Exchange" not in plan(spark, data, name)


@pytest.mark.parametrize(
    "name, column, unread",
    [("topic_scan", "event_type", "props"), ("context_sql_filter", "s_acctbal", "s_nationkey"), ("replay_from", "ts", "props")],
)
def test_filters_and_columns_reach_the_scan(spark, data, name, column, unread):
    text = plan(spark, data, name)
    assert any(column in part.split("]")[0] for part in text.split("PushedFilters: [")[1:])
    assert all(unread not in part for part in text.split("ReadSchema: ")[1:])


@pytest.mark.parametrize("name", ["fraud_flow", "decide", "validation_errors", "ml_linear", "decision_reply", "route_multicast"])
def test_is_compiled_as_a_whole(spark, data, name):
    lines = [line for line in plan(spark, data, name).splitlines() if "Project" in line]
    assert lines and all("*(" in line for line in lines)


@pytest.fixture
def tiny_limits(spark):
    """Limits so small that a skewed key shows on test data."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_of_lookups_and_orphans_are_split(spark, tiny_limits):
    """A third of the rows carry one key; adaptive execution splits it."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("id"))
    rows = spark.range(0, 60000, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    reference = spark.range(0, 60000, 1, 4).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    found = context.lookup(rows, reference, ["k"], limit=0)
    assert "skew=true" in final_plan(found)
    assert found.where("name IS NULL").count() == 0

    at = F.lit("2024-01-01").cast("timestamp_ntz")
    given = rows.select(
        F.col("k").alias("review_id"), F.col("id").alias("reviewer"), F.lit("approved").alias("decision"), at.alias("decided_at"), "pad"
    )
    opened = reference.select(F.col("k").alias("review_id"), at.alias("created_at"), F.lit(60).cast("long").alias("timeout_seconds"))
    late = review.orphans(opened, given, ReviewConfig(required_approvals=2), ["reviewer"])
    assert "skew=true" in final_plan(late)
    assert late.count() == 19998

    values = rows.select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("g"), F.col("id").alias("v"), "pad")
    assert "skew=true" in final_plan(score.robust_zscore(values, ["g"], "v"))


def test_anomalies_take_few_shuffles(spark, data):
    """With broadcasts off, as for tables too large for them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = final_plan(entry_points.queries()["anomaly_zscore"](spark, data))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = text[: text.index("== Initial Plan ==")]
    assert len(re.findall(r"[ -] Exchange ", text)) <= 14
    assert text.count("FileScan") <= 4


def test_a_network_counts_its_data_once(spark, data):
    df = entry_points.queries()["bayes_posterior"](spark, data)
    assert "ReusedExchange" in final_plan(df)
