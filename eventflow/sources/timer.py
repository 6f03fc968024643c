"""Time-triggered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ticks that one task expands at once.
SLAB = 10_000


def ticks(df: DataFrame, ts: str, every: str) -> DataFrame:
    """One row per ``every`` (any day-time interval) from the first day of ``ts`` on, up to its last time.

    Ticks are numbered from the start. Ranges of numbers are spread over the
    cluster and expanded each on its own: no task holds the whole sequence.
    """
    start = F.date_trunc("DAY", F.min(ts)).cast("timestamp_ntz")
    last = F.max(ts).cast("timestamp_ntz")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    step = F.unix_micros(F.expr(f"timestamp_micros(0) + {every}"))
    bounds = df.agg(start.alias("lo"), last.alias("hi")).where(F.col("lo").isNotNull())
    counted = bounds.select("lo", F.floor((micros(F.col("hi")) - micros(F.col("lo"))) / step).alias("last"))
    slabs = counted.select("lo", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / SLAB))).alias("slab"))
    first = F.col("slab") * SLAB
    number = F.explode(F.sequence(first, F.least(first + (SLAB - 1), F.col("last")))).alias("n")
    return slabs.repartition("slab").select("lo", number).select(F.expr(f"lo + ({every}) * n").alias("tick"))


def tick_stream(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """The same as a stream: the built-in rate source."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(
        F.col("timestamp").alias("tick"), F.col("value").alias("tick_id")
    )
