"""The flagship flow: validate, derive features, score risk, route by thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.operators import score, validate
from eventflow.operators.route import route_by_rules
from eventflow.operators.validate import FieldRule, Rules

RULES = Rules(
    {
        "value": FieldRule(required=True, type="number"),
        "event_type": FieldRule(required=True, allowed_values=("view", "click", "purchase", "signup")),
    }
)
THRESHOLDS = {"alerts.high_risk": 0.8, "alerts.medium_risk": 0.6}
WEIGHTS, BIAS = [0.02, 0.05, 1.5], -3.0


def fraud_detection(events: DataFrame) -> DataFrame:
    """One pass, no shuffle: each event with its score and the topic it goes to.

    Works on a table and on a stream alike.
    """
    needed = events.select("event_id", "ts", "event_type", "value")
    checked = validate.validate(needed, RULES)
    ok = validate.is_valid()
    high = F.col("value") > 100
    features = [F.col("value"), F.hour("ts"), high.cast("int")]
    risk = F.round(score.logistic(score.linear_of(features, WEIGHTS, BIAS)), 6)
    scored = checked.select(
        "event_id",
        "value",
        F.when(ok, F.hour("ts").cast("bigint")).alias("tx_hour"),
        F.when(ok, high).alias("is_high_value"),
        F.when(ok, risk).alias("risk_score"),
        ok.alias("accepted"),
    )
    rules = [("NOT accepted", "transactions.errors")]
    rules += [(f"risk_score >= {limit}", topic) for topic, limit in THRESHOLDS.items()]
    return scored.withColumn("topic", route_by_rules(rules, "transactions.processed")).drop("accepted")
