"""Exact per-key sequence operations that never put a whole key in one task.

A plain window partitioned by key sorts all rows of the key in one task, which
breaks down when one key holds a large share of the data. Here the caller names
a ``chunk``: a column that never decreases along the order (a day, a block of
turn numbers). Work is done per (key, chunk); only one summary row per chunk is
combined per key, and its result is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"
PART = "__part"  # struct of key columns and chunk: never NULL, so NULL keys join too


def parted(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    return df.withColumn(PART, F.struct(F.struct(F.lit(0), *keys).alias("k"), chunk.alias("c")))


def across():
    """Window over the chunk summaries of a key."""
    return Window.partitionBy(f"{PART}.k").orderBy(f"{PART}.c")


def running(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key: ``{output name: summed column}``."""
    data = parted(df, keys, chunk)
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = across().rowsBetween(Window.unboundedPreceding, -1)
    totals = data.groupBy(PART).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    offsets = totals.select(PART, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    local = data.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    exact = {n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"__o_{n}") for n in sums}
    return local.join(offsets, on=PART).withColumns(exact).drop(PART, *[f"__o_{n}" for n in sums])


def ranked(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, into: str = "position") -> DataFrame:
    """1-based row number per key."""
    return running(df, keys, order, chunk, {into: F.lit(1).cast("bigint")})


def previous(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str, into: str) -> DataFrame:
    """``lag(value)`` per key; ``order`` names the columns that order a key's rows."""
    data = parted(df, keys, chunk)
    within = Window.partitionBy(PART).orderBy(*order)
    if value == order[0]:  # a plain maximum, which hash aggregation can do
        last = data.groupBy(PART).agg(F.max(value).alias("__last"))
        carried = F.lag("__last").over(across())
    else:
        last = data.groupBy(PART).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__last"))
        carried = F.lag("__last").over(across())["__v"]
    carry = last.select(PART, carried.alias("__carry"))
    local = data.withColumn("__n", F.row_number().over(within)).withColumn(into, F.lag(value).over(within))
    first = F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col(into))
    return local.join(carry, on=PART).withColumn(into, first).drop(PART, "__n", "__carry")


def trailing(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, size: int, item: Column, into: str, block: int = 4096
) -> DataFrame:
    """The last ``size`` items up to and including each row, as an array.

    Rows get their exact position per key, positions are cut into blocks, and
    the tail of a block is repeated at the head of the next one. A task thus
    holds at most ``block + size`` rows of a key.
    """
    block = max(block, size)
    here = F.floor((F.col(_RANK) - 1) / F.lit(block))
    in_tail = F.pmod(F.col(_RANK) - 1, F.lit(block)) > F.lit(block - size)
    own = F.struct(here.alias("b"), F.lit(False).alias("halo"))
    next_one = F.struct((here + 1).alias("b"), F.lit(True).alias("halo"))
    frame = Window.partitionBy(*keys, "__b").orderBy(_RANK).rowsBetween(-(size - 1), 0)
    return (
        ranked(df, keys, order, chunk, _RANK)
        .withColumn("__at", F.explode(F.when(in_tail, F.array(own, next_one)).otherwise(F.array(own))))
        .select("*", F.col("__at.b").alias("__b"), F.col("__at.halo").alias("__halo"))
        .withColumn(into, F.collect_list(item).over(frame))
        .where(~F.col("__halo"))
        .drop("__at", "__b", "__halo", _RANK)
    )


def most_recent(df: DataFrame, keys: list[str], newest_first: list[Column], size: int, chunk: Column | None = None) -> DataFrame:
    """The ``size`` newest rows per key.

    Spark trims each map task to ``size`` rows per key before the shuffle, so a hot
    key does not reach one task whole. It does so for a small ``size``; for a large
    one a ``chunk`` (never decreasing from newest to oldest) splits the key.
    """
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*newest_first)
        numbered = df.withColumn(_RANK, F.row_number().over(w))
    else:
        numbered = ranked(df, keys, newest_first, chunk, _RANK)
    return numbered.where(F.col(_RANK) <= size).drop(_RANK)
