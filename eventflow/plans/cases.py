"""Case handling: anomaly and risk scores, a generated analysis that is checked, and routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.functions.templates import render
from eventflow.operators import decide, prompts, score
from eventflow.operators.decide import Check
from eventflow.operators.flow import fan_in
from eventflow.operators.prompts import Generate
from eventflow.operators.route import route_by_rules
from eventflow.plans.workflow import Workflow

PROMPT = "Analyze case {{doc_id}} in {{lang}}.\nUrgency: {{urgency}}{{#if note}}\nNote: {{note}}{{/if}}"
CHECKS = [
    Check("valid_urgency", "urgency IN ('low', 'high', 'critical')", "Invalid urgency level"),
    Check("has_analysis", "analysis IS NOT NULL", "Missing required fields"),
    Check("short_case", "n_chars <= 20000", "Case too long"),
]
ROUTES = [
    ("size(failed) > 0", "alerts.invalid_output"),
    ("urgency = 'critical'", "alerts.critical"),
    ("urgency = 'high'", "alerts.warning"),
]


def _urgency(cases: DataFrame) -> DataFrame:
    outlier, toxic = F.col("data.z") > 3.0, F.col("label.toxic") == 1
    urgency = F.when(outlier & toxic, "critical").when(outlier | toxic, "high").otherwise("low")
    note = F.when(outlier, F.lit("unusual length"))
    return cases.select("doc_id", "data.lang", "data.n_chars", urgency.alias("urgency"), note.alias("note"))


def case_workflow(load: Callable[[], Generate]) -> Workflow:
    """``load`` builds the text generator, once per task."""

    def analyse(df: DataFrame) -> DataFrame:
        asked = df.withColumn("prompt", render(PROMPT, df.schema))
        return prompts.generate(asked, "prompt", load).withColumnsRenamed({"response": "analysis"})

    def check(df: DataFrame) -> DataFrame:
        return df.withColumn("failed", decide.failed_checks(CHECKS))

    return (
        Workflow("CaseHandling")
        .agent("anomaly", lambda docs: score.robust_zscore(docs, ["lang"], "n_chars"))
        .agent("joined", lambda docs, labels: fan_in({"data": docs, "label": labels}, ["doc_id"]), "anomaly", "labels")
        .agent("urgency", _urgency)
        .agent("analysis", analyse)
        .agent("checked", check)
        .agent("routed", lambda df: df.withColumn("topic", route_by_rules(ROUTES, "updates")))
    )
