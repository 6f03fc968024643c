"""Discrete Bayesian networks as tables.

A factor is a DataFrame with one column per variable and a column ``p``. Its
size is bounded by the product of the variables' domains, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventflow.sources.joins import skew_join


def counts(df: DataFrame, variables: list[str]) -> DataFrame:
    """How often each combination of values occurs: the one pass over the data.

    All tables of a network can be derived from it; Spark then runs the grouping
    once and reuses its shuffle.
    """
    return df.groupBy(*variables).agg(F.count("*").alias("n"))


def prior(joint: DataFrame, variable: str, weight: float = 1.0) -> DataFrame:
    """P(variable) from joint counts, with ``weight`` added to every count."""
    return conditional(joint, variable, [], weight)


def conditional(joint: DataFrame, variable: str, given: list[str], weight: float = 1.0) -> DataFrame:
    """P(variable | given) over the value combinations that occur."""
    cells = joint.groupBy(*given, variable).agg((F.sum("n") + F.lit(weight)).alias("n"))
    return cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*given))).drop("n")


def variables(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c != "p"]


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product of two factors over their shared variables."""
    shared = [v for v in variables(left) if v in variables(right)]
    if not shared:
        raise ValueError("factors without a shared variable are independent; keep them apart")
    joined = left.withColumnRenamed("p", "__a").join(right.withColumnRenamed("p", "__b"), on=shared)
    return joined.withColumn("p", F.col("__a") * F.col("__b")).drop("__a", "__b")


def sum_out(factor: DataFrame, variable: str) -> DataFrame:
    rest = [v for v in variables(factor) if v != variable]
    return factor.groupBy(*rest).agg(F.sum("p").alias("p"))


def posterior(factors: list[DataFrame], query: str, evidence: list[str]) -> DataFrame:
    """P(query | evidence) for every combination of evidence values.

    Factors come in an order where each shares a variable with the ones before.
    """
    joint = factors[0]
    for factor in factors[1:]:
        joint = multiply(joint, factor)
    for hidden in [v for v in variables(joint) if v not in (query, *evidence)]:
        joint = sum_out(joint, hidden)
    share = F.col("p") / F.sum("p").over(Window.partitionBy(*evidence))
    return joint.select(*evidence, query, share.alias("p"))


def infer(df: DataFrame, network: DataFrame, evidence: list[str]) -> DataFrame:
    """Attach the posterior to data rows; one row per value of the query variable."""
    return skew_join(df, network, evidence, "left")
