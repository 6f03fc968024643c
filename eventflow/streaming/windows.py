"""Event time: watermarks, duplicates, windowed metrics, session batches, fan-in of streams.

Default lateness is ten minutes; rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENESS = "10 minutes"
#: Values a quantile sketch keeps on its lowest level.
SKETCH_SIZE = 2048


def event_time(df: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Watermark on ``ts``, which is cast from a zone-less timestamp if need be."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def without_duplicates(df: DataFrame, message_id: str = "message_id") -> DataFrame:
    """Each message once; a repeat must arrive within the watermark's lateness."""
    return df.dropDuplicatesWithinWatermark([message_id])


def error_rate(df: DataFrame, failed: Column, every: str, keys: list[str] = (), ts: str = "ts") -> DataFrame:
    """Count and share of failed events per window; a window comes out once it is complete."""
    grouped = df.groupBy(F.window(ts, every).alias("w"), *keys).agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("errors"),
        F.avg(F.coalesce(failed, F.lit(False)).cast("double")).alias("error_rate"),
    )
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "errors", "error_rate")


def quantile_sketches(
    df: DataFrame, value: Column, every: str, keys: list[str] = (), ts: str = "ts", k: int = SKETCH_SIZE
) -> DataFrame:
    """A mergeable sketch of ``value`` per window and key, in a batch or a stream: ``window_start``, keys, ``n``, ``sketch``.

    State is one sketch of bounded size per open window and key; a window comes out once it is complete.
    NULLs are not counted; a window of NULLs alone has no sketch.
    """
    number = value.cast("double")
    grouped = df.groupBy(F.window(ts, every).alias("w"), *keys).agg(
        F.count(number).alias("n"), F.kll_sketch_agg_double(number, k).alias("sketch")
    )
    held = F.when(F.col("n") > 0, F.col("sketch")).alias("sketch")
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", held)


def merged_sketches(sketches: DataFrame, every: str, keys: list[str] = (), k: int = SKETCH_SIZE) -> DataFrame:
    """The same for windows that contain those of ``quantile_sketches``, from the sketches alone."""
    some = sketches.where(F.col("n") > 0)
    grouped = some.groupBy(F.window("window_start", every).alias("w"), *keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "sketch")


def sketched_quantile(share: float, sketch: str = "sketch") -> Column:
    """The least value with at least this share of the values at or below it, within the sketch's rank error; NULL without a sketch.

    The error is about 2.3 / k ** 0.97 of the count, with 99 % confidence (0.14 % at the default); a sketch of at most ``k`` values is exact.
    """
    return F.when(F.col(sketch).isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def session_batches(df: DataFrame, key: str, idle: str = "100 milliseconds", ts: str = "ts") -> DataFrame:
    """Size and span of each batch that a pause of ``idle`` closes."""
    grouped = df.groupBy(F.session_window(ts, idle).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def fan_in(left: DataFrame, right: DataFrame, on: str, within: str, left_ts: str = "ts", right_ts: str = "ts") -> DataFrame:
    """Two results of the same message, at most ``within`` apart. Both sides carry watermarks.

    The time bound lets Spark forget a side that can no longer be matched.
    """
    other = right.withColumnsRenamed({on: "__on", right_ts: "__ts"})
    bound = F.expr(f"__ts BETWEEN {left_ts} - INTERVAL {within} AND {left_ts} + INTERVAL {within}")
    return left.join(other, (F.col(on) == F.col("__on")) & bound, "inner").drop("__on", "__ts")
