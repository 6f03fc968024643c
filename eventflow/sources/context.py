"""Reference data that agents look things up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import skew_join

BROADCAST_LIMIT = 16 * 1024 * 1024

# Plan nodes that may give more rows than they get without Spark's estimate showing it.
_GROWING = ("Generate", "Expand", "InPandas", "InArrow", "ScriptTransformation")
UNKNOWN = 1 << 62


def plan_size(df: DataFrame) -> int:
    """Spark's own upper estimate of a DataFrame's bytes; ``UNKNOWN`` if it cannot be trusted."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(node in plan.toString() for node in _GROWING):
        return UNKNOWN
    return int(str(plan.stats().sizeInBytes()))


def sized(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark for broadcast only if the size is known to be below ``limit``.

    Larger data comes back as it is: the join then shuffles, and adaptive
    execution splits the keys that turn out hot.
    """
    return F.broadcast(df) if plan_size(df) <= limit else df


def lookup(df: DataFrame, reference: DataFrame, on: list[str], limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Enrich rows by key; rows without a match keep NULLs."""
    if plan_size(reference) <= limit:
        return df.join(F.broadcast(reference), on=on, how="left")
    return skew_join(df, reference, on, "left")


def database_lookup(df: DataFrame, table: DataFrame, where: dict[str, str]) -> DataFrame:
    """``SELECT * FROM table WHERE column = {{field}}`` for all events at once.

    ``where`` maps table columns to event fields. One join, not a query per event.
    """
    names = {column: f"__{column}" for column in where}
    asked = df.withColumns({names[column]: F.col(path) for column, path in where.items()})
    return lookup(asked, table.withColumnsRenamed(names), list(names.values())).drop(*names.values())


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """A database table read in ``parts`` parallel key ranges."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
        .options(**options)
        .load()
    )


def sql_context(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Filtered reference data in SQL; ``{name}`` in the text stands for a view argument."""
    return spark.sql(text, **views)


def knowledge_base(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.format(format).load(path)


def context_text(reference: DataFrame, line: Column, order: str) -> Column:
    """A context set as one text, for use inside prompts: all its lines, whatever their number.

    The text is one value and is repeated in every prompt, so its size is the caller's choice.
    """
    lines = reference.select(F.struct(F.col(order).alias("k"), line.alias("line")).alias("s"))
    ordered = F.array_sort(F.collect_list("s"))
    return lines.agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("context")).scalar()
