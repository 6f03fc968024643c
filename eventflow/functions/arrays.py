"""Building arrays from conditional items without leaving generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(cases: list[tuple[Column, Column]], item_type: str) -> Column:
    """The values whose test holds, in the given order.

    Spark's ``array_compact`` is a higher-order function, which is interpreted;
    a ``concat`` of conditional one-item arrays is compiled.
    """
    none = F.array().cast(f"array<{item_type}>")
    parts = [F.when(test, F.array(value.cast(item_type))).otherwise(none) for test, value in cases]
    return F.concat(*parts) if parts else none


def last_at_most(sorted_values: list[int], value: Column) -> Column:
    """The greatest of some numbers that does not exceed ``value``, else NULL."""
    known = F.lit(sorted_values).cast("array<bigint>")
    return F.try_element_at(F.filter(known, lambda v: v <= value), F.lit(-1))
