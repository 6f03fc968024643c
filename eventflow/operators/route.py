"""Routing: which topics a message goes to, and what is done on the way."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.conditions import holds
from eventflow.functions.patterns import is_valid_pattern, search
from eventflow.sources.context import lookup

from .decide import by_priority, first_match

# Defaults of an action, known log levels, the default action's text.
FORWARD_TIMEOUT = 30
LOG_LEVELS = ("error", "warn", "info", "debug", "trace")
NO_ROUTE = "No matching route found"

ACTION_TYPE = (
    "struct<type:string,target:string,transform:string,script:string,"
    "headers:map<string,string>,timeout_secs:bigint,message:string,level:string>"
)


@dataclass(frozen=True)
class Action:
    """One step of a route: ``publish``, ``forward``, ``log`` or ``transform``."""

    type: str
    target: str | None = None
    transform: str | None = None
    script: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    timeout_secs: int = FORWARD_TIMEOUT
    message: str | None = None
    level: str = "info"


DEFAULT_ACTION = Action("log", message=NO_ROUTE, level="warn")


@dataclass(frozen=True)
class Route:
    """A pattern searched in the payload, plus predicates in Spark SQL."""

    id: str
    pattern: str
    actions: tuple[Action, ...]
    conditions: tuple[str, ...] = ()
    priority: int = 0
    enabled: bool = True
    description: str = ""


def load_routes(text: str) -> list[Route]:
    """Routes from the JSON text of a routes file."""
    routes = []
    for r in json.loads(text):
        r = dict(r, actions=tuple(Action(**a) for a in r["actions"]), conditions=tuple(r.get("conditions", ())))
        routes.append(Route(**r))
    return routes


def usable(routes: list[Route]) -> list[Route]:
    """Enabled routes with a valid pattern, best first."""
    return by_priority([r for r in routes if r.enabled and is_valid_pattern(r.pattern)])


def route_matches(route: Route, payload: Column, compat: bool = False) -> Column:
    """Pattern found and all conditions met.

    ``compat`` gives the looser historic rule: pattern found, or no conditions.
    """
    found = search(payload, route.pattern)
    if compat:
        return F.lit(True) if not route.conditions else found
    for text in route.conditions:
        found = found & holds(text)
    return found


def _action(a: Action) -> Column:
    headers = F.create_map(*[F.lit(x) for pair in a.headers.items() for x in pair])
    level = a.level if a.level in LOG_LEVELS else "info"
    return F.struct(
        F.lit(a.type).alias("type"),
        F.lit(a.target).alias("target"),
        F.lit(a.transform).alias("transform"),
        F.lit(a.script).alias("script"),
        headers.alias("headers"),
        F.lit(a.timeout_secs).alias("timeout_secs"),
        F.lit(a.message).alias("message"),
        F.lit(level if a.type == "log" else None).alias("level"),
    ).cast(ACTION_TYPE)


def _actions(actions: tuple[Action, ...]) -> Column:
    return F.array(*[_action(a) for a in actions]).cast(f"array<{ACTION_TYPE}>")


def actions_of(
    routes: list[Route],
    payload: Column,
    stop_after_first_match: bool = True,
    default: Action = DEFAULT_ACTION,
    compat: bool = False,
) -> Column:
    """The actions for a message, as an array; never empty."""
    none = F.array().cast(f"array<{ACTION_TYPE}>")
    cases = [(route_matches(r, payload, compat), _actions(r.actions)) for r in usable(routes)]
    if stop_after_first_match:
        chosen = first_match(cases, none)
    elif cases:
        chosen = F.flatten(F.array(*[F.when(hit, acts).otherwise(none) for hit, acts in cases]))
    else:
        chosen = none
    return F.when(F.size(chosen) == 0, _actions((default,))).otherwise(chosen)


def route(df: DataFrame, routes: list[Route], payload: str = "payload", compat: bool = False, **options) -> DataFrame:
    """One row per message and action: columns ``action_no`` (from 0) and ``action``.

    With ``compat`` the actions after a ``transform`` are not carried out.
    """
    chosen = df.withColumn("actions", actions_of(routes, F.col(payload), compat=compat, **options))
    exploded = chosen.select("*", F.posexplode("actions").alias("action_no", "action"))
    if compat:
        kinds = F.transform("actions", lambda a: a["type"])
        first_transform = F.array_position(kinds, "transform")
        exploded = exploded.where((first_transform == 0) | (F.col("action_no") < first_transform - 1))
    return exploded.drop("actions").withColumn("action_no", F.col("action_no").cast("bigint"))


def _scripts(routes: list[Route], attribute: str) -> list[str]:
    return sorted({s for r in usable(routes) for a in r.actions if (s := getattr(a, attribute))})


def deliveries(routed: DataFrame, routes: list[Route], payload: str = "payload", headers: str | None = None) -> DataFrame:
    """Messages to send: ``topic``, the payload after transforms, merged headers.

    Publish may carry a ``transform``, a transform action has a ``script``;
    both are Spark SQL expressions over the message's columns.
    """
    sends = routed.where(F.col("action.type").isin("publish", "forward", "transform"))
    text = F.col(payload)
    for attribute in ("transform", "script"):
        cases = [(F.col(f"action.{attribute}") == s, F.expr(s).cast("string")) for s in _scripts(routes, attribute)]
        text = first_match(cases, text)
    extra = F.col("action.headers")
    merged = F.map_concat(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")), extra) if headers else extra
    return sends.withColumns({"topic": F.col("action.target"), payload: text, "out_headers": merged})


def log_lines(routed: DataFrame) -> DataFrame:
    """The log actions as rows: ``level``, ``message``."""
    return routed.where(F.col("action.type") == "log").withColumns(
        {"level": F.col("action.level"), "message": F.col("action.message")}
    )


def route_by_rules(rules: list[tuple[str, str]], default: str) -> Column:
    """Topic of the first ``(Spark SQL predicate, target)`` that holds."""
    return first_match([(holds(text), F.lit(target)) for text, target in rules], F.lit(default))


def route_by_lookup(df: DataFrame, table: DataFrame, on: list[str], target: str, default: str) -> DataFrame:
    """Table-driven target per key."""
    return lookup(df, table, on).withColumn("topic", F.coalesce(F.col(target), F.lit(default))).drop(target)
