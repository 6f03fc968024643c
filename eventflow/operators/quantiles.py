"""Exact, interpolated quantiles per key, without gathering a key's values.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer. Here a bounded sketch per key brackets each wanted rank; the rows are
then counted, those inside a bracket by value and those between brackets as
one number, which combines on the map side. Only the values inside brackets, a
thousandth of a key's rows or so, are put in order. One form serves all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.sources.joins import skew_join

#: Relative accuracy of the sketch (1 / ACCURACY of the ranks), and how much wider a bracket is.
ACCURACY = 10_000
SLACK = 4 / ACCURACY

KEY = "__k"


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the key as one struct: never NULL, so rows with a NULL key join like others."""
    return df.withColumn(KEY, F.struct(F.lit(0).alias("_"), *keys))


def _order(v: Column) -> Column:
    """The value for the sketch, which knows no NaN: NaN sorts last, with infinity."""
    return F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)


def _attach(rows: DataFrame, per_key: DataFrame, hot: bool = False) -> DataFrame:
    """Joins what is known per key; where there are no keys that is one row, read as a scalar.

    ``hot``: the rows of a key can be many, so a hot key must be split.
    """
    if len(rows.schema[KEY].dataType.fields) > 1:
        return skew_join(rows, per_key, [KEY]) if hot else rows.join(per_key, KEY)
    names = [c for c in per_key.columns if c != KEY]
    one = per_key.agg(F.first(F.struct(*names)).alias("one")).scalar()
    return rows.withColumns({c: one[c] for c in names})


def summary_by_key(data: DataFrame, value: Column, aggregates: list[Column], fractions: dict[str, float]) -> DataFrame:
    """One row per ``__k``: the aggregates (over a column ``x``) and a column for each entry of ``fractions``.

    ``data`` carries ``__k`` (see ``keyed``). NULL values are left out, and so are keys that have nothing else.
    """
    names, qs = list(fractions), [float(q) for q in fractions.values()]
    rows = data.select(KEY, value.cast("double").alias("x")).where(F.col("x").isNotNull())
    ends = [e for q in qs for e in (max(0.0, q - SLACK), min(1.0, q + SLACK))]
    sketch = rows.groupBy(KEY).agg(
        F.count("*").alias("__total"), F.percentile_approx(_order(F.col("x")), ends, ACCURACY).alias("__cuts"), *aggregates
    )
    joined = _attach(rows, sketch.select(KEY, "__total", "__cuts"), hot=True)
    at, cuts = _order(F.col("x")), F.col("__cuts")
    # The slack is some ranks wide only if a key has that many rows; a bracket holds fewer of them whole.
    inside, before = F.col("__total") <= ACCURACY, F.lit(0)
    for i in range(len(qs)):
        # The first and last bracket are open, so that the least and greatest values are always inside.
        above = F.lit(True) if ends[2 * i] == 0.0 else at >= cuts[2 * i]
        below = F.lit(True) if ends[2 * i + 1] == 1.0 else at <= cuts[2 * i + 1]
        inside = inside | (above & below)
        before = before + F.when(below, 0).otherwise(1)
    # Rows outside are told apart by how many brackets lie before them.
    cells = joined.select(KEY, "x", "__total", F.when(inside, F.lit(-1)).otherwise(before).alias("__gap"), F.when(inside, F.col("x")).alias("__v"))
    counts = cells.groupBy(KEY, "__gap", "__v").agg(
        F.count("*").alias("__n"), F.min("x").alias("__at"), F.max("__total").alias("__total")
    )
    placed = counts.withColumn("__end", F.sum("__n").over(Window.partitionBy(KEY).orderBy("__at", "__gap").rowsBetween(Window.unboundedPreceding, 0)))
    held = lambda rank: (F.col("__end") - F.col("__n") <= rank) & (rank < F.col("__end"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    value_at = lambda rank: F.max(F.when(held(rank), F.when(F.col("__gap") == -1, F.col("__v")).otherwise(missed)))
    ranks = [F.lit(q) * (F.col("__total") - 1) for q in qs]
    slots = placed.groupBy(KEY).agg(
        F.max("__total").alias("__total"),
        *[f for i, r in enumerate(ranks) for f in (value_at(F.floor(r)).alias(f"__low{i}"), value_at(F.ceil(r)).alias(f"__high{i}"))]
    )
    found = _attach(slots, sketch.drop("__total", "__cuts")) if aggregates else slots
    out = []
    for i, (name, rank) in enumerate(zip(names, ranks)):
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        between = low + (high - low) * (rank - F.floor(rank))
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    rest = [c for c in sketch.columns if c not in (KEY, "__total", "__cuts")]
    return found.select(KEY, *rest, *out)


def summary(df: DataFrame, keys: list[str], value: Column, aggregates: list[Column], fractions: dict[str, float]) -> DataFrame:
    """``aggregates`` (over a column ``x``) and exact quantiles of ``value`` per key.

    Linear interpolation between neighbouring values, like ``percentile``.
    """
    found = summary_by_key(keyed(df, keys), value, aggregates, fractions)
    return found.select(*[F.col(KEY)[k].alias(k) for k in keys], *[c for c in found.columns if c != KEY])


def quantiles(df: DataFrame, keys: list[str], value: Column, fractions: dict[str, float]) -> DataFrame:
    """Exact quantiles per key."""
    return summary(df, keys, value, [], fractions)
