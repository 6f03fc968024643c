"""Filling missing values with a statistic of the column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def impute(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """Replace NULLs by the column's mean or median.

    The statistic is a scalar subquery: computed once and handed to the scan,
    so the data itself is not shuffled.
    """
    if strategy == "mean_imputation":
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("fill")).scalar()
        return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})
    if strategy == "median_imputation":
        fills = {c: quantiles(df, [], F.col(c), {"fill": 0.5}).scalar() for c in columns}
        return df.withColumns({c: F.coalesce(F.col(c), fills[c]) for c in columns})
    raise ValueError(f"unknown strategy: {strategy}")
