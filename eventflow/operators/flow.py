"""Putting agents together: chains, guards, fan-in, fallbacks, subworkflows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.arrays import pick
from eventflow.functions.conditions import holds

Step = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    """Agents one after another; preprocessors simply come first."""
    return reduce(lambda acc, step: acc.transform(step), steps, df)


def guarded(df: DataFrame, when: str, step: Step | dict[str, Column]) -> DataFrame:
    """Run ``step`` on rows that meet ``when``; the others pass by unchanged.

    A step given as columns is applied in the same pass; a function reads its
    rows and the bypassed ones separately. A new column is NULL where bypassed.
    """
    test = holds(when)
    if isinstance(step, dict):
        kept = {c: F.col(c) if c in df.columns else F.lit(None) for c in step}
        return df.withColumns({c: F.when(test, value).otherwise(kept[c]) for c, value in step.items()})
    return step(df.where(test)).unionByName(df.where(~test), allowMissingColumns=True)


def fan_in(inputs: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """One row per message that every input has, each input as a struct column."""

    def packed(name: str, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        return df.select(*on, F.struct(*rest).alias(name))

    parts = [packed(name, df) for name, df in inputs.items()]
    return reduce(lambda a, b: a.join(b, on=on, how="inner"), parts)


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Messages the right input never saw."""
    return left.join(right.select(*on), on=on, how="left_anti")


def merge_back(primary: DataFrame, secondary: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``secondary ?? primary`` per column, for every row of ``primary``."""
    renamed = secondary.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = primary.join(renamed, on=on, how="left")
    merged = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}
    return joined.withColumns(merged).drop(*[f"__{c}" for c in columns])


def with_fallback(df: DataFrame, failed: Column, alternative: Step | dict[str, Column]) -> DataFrame:
    """Failed rows go through an alternative; ``handled_by`` tells which one it was.

    An alternative given as columns costs no second pass over the data.
    """
    bad = F.coalesce(failed, F.lit(False))
    if isinstance(alternative, dict):
        replaced = {c: F.when(bad, value).otherwise(F.col(c)) for c, value in alternative.items()}
        return df.withColumns({**replaced, "handled_by": F.when(bad, "fallback").otherwise("primary")})
    good = df.where(~bad).withColumn("handled_by", F.lit("primary"))
    other = alternative(df.where(bad)).withColumn("handled_by", F.lit("fallback"))
    return good.unionByName(other, allowMissingColumns=True)


def subworkflow(
    body: Callable[..., dict[str, DataFrame]], inputs: dict[str, tuple[DataFrame, dict[str, str]]], outputs: dict[str, dict[str, str]]
) -> dict[str, DataFrame]:
    """Call a reusable part through explicit mappings.

    ``inputs[name] = (df, {outer column: inner column})``: the part sees these
    columns only. ``outputs[name] = {inner column: outer column}``.
    """
    seen = {
        name: df.select(*[F.col(outer).alias(inner) for outer, inner in mapping.items()])
        for name, (df, mapping) in inputs.items()
    }
    results = body(**seen)
    return {
        name: results[name].select(*[F.col(inner).alias(outer) for inner, outer in mapping.items()])
        for name, mapping in outputs.items()
    }


def collect_errors(steps: dict[str, DataFrame], key: str, error: str = "error") -> DataFrame:
    """Errors of agents with results of their own as one table: ``agent``, key, ``error``."""
    parts = [
        df.where(F.col(error).isNotNull()).select(F.lit(agent).alias("agent"), F.col(key), F.col(error).alias("error"))
        for agent, df in steps.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def errors_of(df: DataFrame, key: str, errors: dict[str, Column]) -> DataFrame:
    """The same where the agents' errors are columns of one table: a single pass."""
    found = [
        (error.isNotNull(), F.struct(F.lit(agent).alias("agent"), error.alias("error")))
        for agent, error in errors.items()
    ]
    return df.select(key, F.explode(pick(found, "struct<agent:string,error:string>")).alias("e")).select("e.agent", key, "e.error")


def custom(df: DataFrame, on_batch: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's own agent: a function from one batch of messages to its results."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (on_batch(pdf) for pdf in batches)

    return df.mapInPandas(run, schema)


def step_status(start: Column, end: Column, timeout_seconds: float) -> Column:
    """``timed_out`` where a step took longer than allowed (or never ended), else ``ok``."""
    took = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    in_time = F.coalesce(took <= F.lit(int(timeout_seconds * 1_000_000)), F.lit(False))
    return F.when(in_time, "ok").otherwise("timed_out")
