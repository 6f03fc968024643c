"""Monitoring figures per key and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import summary


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


QUANTILES = {"p50": 0.5, "p95": 0.95}


def latency(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Count, mean, maximum and exact quantiles of a duration."""
    figures = [F.count("*").alias("n"), F.avg("x").alias("avg_seconds"), F.max("x").alias("max_seconds")]
    return summary(df, keys, seconds, figures, QUANTILES)


def error_rate(df: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("errors"),
        F.avg(F.coalesce(failed, F.lit(False)).cast("double")).alias("error_rate"),
    )


def score_distribution(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    figures = [F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev")]
    return summary(df, keys, value, figures, QUANTILES)


def throughput(df: DataFrame, ts: str, every_seconds: int) -> DataFrame:
    """Events per second in tumbling windows that have events."""
    w = F.window(F.col(ts), f"{every_seconds} seconds")
    return df.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "n", (F.col("n") / F.lit(float(every_seconds))).alias("per_second")
    )


def progress(df: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """``n/m completed (p%)`` as columns and as text."""
    counted = df.groupBy(*keys).agg(F.count_if(done).alias("done"), F.count("*").alias("total"))
    percent = F.floor(F.col("done") * 100 / F.col("total")).cast("bigint")
    return counted.withColumn("percent", percent).withColumn(
        "progress",
        F.format_string("%d/%d completed (%d%%)", "done", "total", "percent"),
    )
