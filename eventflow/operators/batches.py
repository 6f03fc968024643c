"""Micro-batches: consecutive messages of a key, closed by a pause or by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import PART, across, parted

# Default batch size, and the idle time in seconds that closes a batch.
BATCH_SIZE = 32
IDLE_SECONDS = 0.1


def micro_batches(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    chunk: Column,
    size: int = BATCH_SIZE,
    idle_seconds: float = IDLE_SECONDS,
) -> DataFrame:
    """Add ``session`` (1, 2, .. per key), ``position`` in it (from 1) and ``batch`` (from 0).

    A row opens a session if it is its key's first or comes more than
    ``idle_seconds`` after the row before it. ``order`` starts with ``ts``.
    """
    limit = int(idle_seconds * 1_000_000)

    def pause(earlier: Column, later: Column) -> Column:
        """True where ``later`` comes too long after ``earlier``, or there is no earlier row."""
        gap = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
        return earlier.isNull() | (gap > limit)

    # Within a chunk: row numbers, and the rows (but the first) that open a session.
    within = Window.partitionBy(PART).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        parted(df, keys, chunk)
        .withColumn("__n", F.row_number().over(within).cast("bigint"))
        .withColumn("__opens", (F.col("__n") > 1) & pause(F.lag(ts).over(within), F.col(ts)))
        .withColumn("__open_row", F.when(F.col("__opens"), F.col("__n")))
    )

    # Per chunk: what the chunks before it add up to, and whether its first row opens a session.
    chunks = local.groupBy(PART).agg(
        F.count("*").alias("rows"),
        F.count("__open_row").alias("opened"),
        F.max("__open_row").alias("last_open"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )
    before = across().rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        chunks.withColumn("__first_opens", pause(F.lag("last_ts").over(across()), F.col("first_ts")).cast("bigint"))
        .withColumn("__rows", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("__sessions", F.coalesce(F.sum(F.col("opened") + F.col("__first_opens")).over(before), F.lit(0)))
        .withColumn("latest", F.coalesce("last_open", F.when(F.col("__first_opens") == 1, F.lit(1))) + F.col("__rows"))
        .withColumn("__start", F.max("latest").over(before))
        .select(PART, "__first_opens", "__rows", "__sessions", "__start")
    )

    first_start = F.when(F.col("__first_opens") == 1, F.col("__rows") + 1).otherwise(F.col("__start"))
    start = F.coalesce(F.col("__rows") + F.col("__here_start"), first_start)
    return (
        local.withColumn("__here", F.count("__open_row").over(so_far))
        .withColumn("__here_start", F.max("__open_row").over(so_far))
        .join(chunks, on=PART)
        .withColumn("session", F.col("__sessions") + F.col("__first_opens") + F.col("__here"))
        .withColumn("position", F.col("__rows") + F.col("__n") - start + 1)
        .withColumn("batch", F.floor((F.col("position") - 1) / size).cast("bigint"))
        .select(*df.columns, "session", "position", "batch")
    )
