"""Text analysis: clean, score, alert on high scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.operators.normalize import clean_text
from eventflow.operators.route import route_by_rules

STEPS = ["trim", "lowercase", "remove_special_chars"]
RULES = [("score > 0.8", "alerts.high_sentiment")]


def word_variety(text: Column) -> Column:
    """A stand-in for a trained scorer: the share of different words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), F.lit(0.0))


def sentiment(texts: DataFrame, score: Callable[[Column], Column] = word_variety) -> DataFrame:
    """Adds ``score`` and ``topic``; one pass, on a table or a stream."""
    cleaned = texts.withColumn("text", clean_text(F.col("text"), STEPS))
    scored = cleaned.withColumn("score", F.round(score(F.col("text")), 6))
    return scored.withColumn("topic", route_by_rules(RULES, "analysis.results"))
