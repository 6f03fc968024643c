"""Data-quality checks over catalogues of named things."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.arrays import pick

# Fixed value: letters, digits and underscores, not starting with a digit.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def distinct_items(df: DataFrame, key: str, item: str) -> DataFrame:
    return df.select(key, item).distinct()


def distinct_lists(df: DataFrame, key: str, item: str) -> DataFrame:
    """Sorted distinct items per key, for items of a small domain such as types.

    Duplicates go before anything is collected. Where a key may have any number
    of different items, take the rows of ``distinct_items`` instead.
    """
    return distinct_items(df, key, item).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))


def duplicates(*parts: DataFrame) -> DataFrame:
    """Keys that occur more than once across the given single-kind tables."""
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    return merged.groupBy(*merged.columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def is_blank(text: Column) -> Column:
    """Missing, empty, or white space only."""
    return F.coalesce(F.regexp_replace(text, r"\s+", "") == "", F.lit(True))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def lacks_any(config: Column, keys: list[str]) -> Column:
    """True where a string map has none of the keys."""
    present = reduce(lambda a, b: a | b, [F.map_contains_key(config, k) for k in keys])
    return ~F.coalesce(present, F.lit(False))


def error_rows(df: DataFrame, scope: str, checks: dict[str, Column]) -> DataFrame:
    """One row per failed check: ``scope``, ``error``. Not aggregated, so of any size."""
    failed = pick([(bad, F.lit(text)) for text, bad in checks.items()], "string")
    return df.select(F.col(scope).alias("scope"), F.explode(failed).alias("error"))


def report(scopes: DataFrame, errors: DataFrame) -> DataFrame:
    """``{scope, valid, error_count, errors}`` per scope.

    ``errors`` lists each kind of error once with its count, so its length is
    bounded by the number of checks; the rows themselves stay in ``errors``.
    """
    kinds = errors.groupBy("scope", "error").agg(F.count("*").alias("n"))
    line = F.concat(F.col("error"), F.lit(" x"), F.col("n").cast("string"))
    lists = kinds.groupBy("scope").agg(F.sum("n").alias("error_count"), F.array_sort(F.collect_list(line)).alias("errors"))
    joined = scopes.select("scope").distinct().join(lists, on="scope", how="left")
    return joined.select(
        "scope",
        F.col("error_count").isNull().alias("valid"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    )
