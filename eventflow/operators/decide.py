"""Decisions from prioritised rules, and named checks with a failure policy."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions.arrays import pick
from eventflow.functions.conditions import all_of, holds
from eventflow.sources.context import lookup

# Fixed value: the decision where no rule matches and none is configured.
DEFAULT_DECISION = "unknown"


@dataclass(frozen=True)
class Rule:
    """All ``conditions`` must hold; without any the rule matches every row."""

    id: str
    decision: str
    conditions: tuple[dict, ...] = ()
    priority: int = 0
    description: str | None = None


def load_rules(text: str) -> list[Rule]:
    """Rules from the JSON text of a rules file, in file order."""
    return [
        Rule(r["id"], r["decision"], tuple(r["conditions"]), r["priority"], r.get("description"))
        for r in json.loads(text)
    ]


def by_priority(items: list) -> list:
    """Highest priority first; equal priorities stay in the given order."""
    return sorted(items, key=lambda item: -item.priority)


def matches(rule: Rule, schema: T.StructType) -> Column:
    return all_of(list(rule.conditions), schema)


def first_match(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds: one flat CASE, however many cases there are."""
    if not cases:
        return default
    (test, value), *rest = cases
    return reduce(lambda chain, case: chain.when(*case), rest, F.when(test, value)).otherwise(default)


def decision(rules: list[Rule], schema: T.StructType, default: str = DEFAULT_DECISION) -> Column:
    """Decision of the best matching rule, as one CASE expression."""
    cases = [(matches(r, schema), F.lit(r.decision)) for r in by_priority(rules)]
    return first_match(cases, F.lit(default))


def decide(df: DataFrame, rules: list[Rule], default: str = DEFAULT_DECISION, into: str = "decision") -> DataFrame:
    """Add the decision; the input columns are carried along."""
    return df.withColumn(into, decision(rules, df.schema, default))


def matching_rules(rules: list[Rule], schema: T.StructType) -> Column:
    """Ids of all matching rules, best first."""
    return pick([(matches(r, schema), F.lit(r.id)) for r in by_priority(rules)], "string")


def decide_by_table(
    df: DataFrame, rules: DataFrame, on: list[str], test: Callable[[Column], Column], default: str = DEFAULT_DECISION
) -> DataFrame:
    """Decide by rules kept in a table with columns ``priority, ord, decision`` and more.

    Rules apply to rows with equal ``on`` columns. The rules of one key are
    folded into a sorted array first, so each row meets them in one lookup and
    is not multiplied; ``test`` tells whether a rule (a struct) matches.
    """
    best_first = F.struct(
        (-F.col("priority")).alias("__rank"), "ord", *[c for c in rules.columns if c not in ("ord", *on)]
    )
    folded = rules.groupBy(*on).agg(F.array_sort(F.collect_list(best_first)).alias("__rules"))
    hits = F.filter("__rules", lambda r: F.coalesce(test(r), F.lit(False)))
    chosen = F.try_element_at(hits, F.lit(1))["decision"]
    return lookup(df, folded, on).withColumn("decision", F.coalesce(chosen, F.lit(default))).drop("__rules")


@dataclass(frozen=True)
class Check:
    """A named predicate in Spark SQL and the message if it is not met."""

    name: str
    condition: str
    error: str


def failed_checks(checks: list[Check]) -> Column:
    """``{name, error}`` for each check that fails; a NULL result is a failure."""
    failed = [(~holds(c.condition), F.struct(F.lit(c.name).alias("name"), F.lit(c.error).alias("error"))) for c in checks]
    return pick(failed, "struct<name:string,error:string>")


def failure_route(failed: Column, attempt: Column, retries: int, ok_topic: str, retry_topic: str, reject_topic: str) -> Column:
    """Topic of a row: quarantined for another try up to ``retries`` times, then rejected."""
    return (
        F.when(~failed, F.lit(ok_topic))
        .when(attempt <= retries, F.lit(retry_topic))
        .otherwise(F.lit(reject_topic))
    )
