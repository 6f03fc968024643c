"""Condition trees as columns, with two-valued logic.

A condition is a dict: ``{"op": "gt", "field": "score", "value": 50}``, nested
with ``and`` / ``or`` (key ``conditions``) and ``not`` (key ``condition``). A
missing field gives a definite answer, never NULL: ``ne`` holds, every other
leaf does not. So ``not`` over a missing field holds as well. Numbers compare exactly,
whatever the types; a fraction in a condition means the decimal number it is written as.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from numbers import Number

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Field, resolve
from .patterns import search

_FALSE, _TRUE = False, True


def _is_number(value: object) -> bool:
    return isinstance(value, Number) and not isinstance(value, bool)


def _always(column: Column, outcome: bool) -> Column:
    return F.when(column.isNotNull(), F.lit(outcome))


def _against_double(column: Column, op: str, value: Number) -> Column:
    """A double against a number no double may equal: the doubles next to it decide."""
    try:
        near = float(value)
    except OverflowError:
        near = math.inf if value > 0 else -math.inf
    bound = F.lit(near)
    if not isinstance(value, float):
        above = near == math.inf or (near > -math.inf and Fraction(near) > Fraction(value))
        below = near == -math.inf or (near < math.inf and Fraction(near) < Fraction(value))
        if op == "eq" and (above or below):
            return _always(column, False)
        if op == "gt" and above:
            bound = F.lit(math.nextafter(near, -math.inf))
        if op == "lt" and below:
            bound = F.lit(math.nextafter(near, math.inf))
    return column == bound if op == "eq" else column > bound if op == "gt" else column < bound


def _against_fixed(column: Column, kind: T.DataType, op: str, value: Number) -> Column:
    """An integer or decimal column against a number: exact, whatever the digits of both."""
    if isinstance(kind, T.DecimalType):
        scale, low, high = kind.scale, 1 - 10**kind.precision, 10**kind.precision - 1
    else:
        scale, low, high, column = 0, -(1 << 63), (1 << 63) - 1, column.cast("bigint")
    scaled = Fraction(Decimal(str(value))) * 10**scale
    if op == "eq":
        bound = scaled.numerator
        if scaled.denominator != 1 or not low <= bound <= high:
            return _always(column, False)
    else:
        bound = math.floor(scaled) if op == "gt" else math.ceil(scaled)
        if not low <= bound <= high:
            return _always(column, (bound < low) == (op == "gt"))
    if isinstance(kind, T.DecimalType):
        digits = tuple(map(int, str(abs(bound))))
        literal = F.lit(Decimal((int(bound < 0), digits, -scale))).cast(kind)
    else:
        literal = F.lit(bound).cast("bigint")
    return column == literal if op == "eq" else column > literal if op == "gt" else column < literal


#: Decimals inside a variant are compared with 18 places, those of more than 20 digits before the point without.
_VARIANT_DECIMALS = (T.DecimalType(38, 18), T.DecimalType(38, 0))


def _compare(found: Field, op: str, value: Number) -> Column | None:
    """``eq``, ``gt`` or ``lt`` of numbers in a type that holds both; NULL without a number, None for other declared types."""
    whole = not isinstance(value, float) or math.isfinite(value)
    if isinstance(found.type, T.VariantType):
        kind = F.schema_of_variant(found.column)
        read = lambda t: F.try_variant_get(found.column, "$", t)
        double = _against_double(read("double"), op, value)
        if not whole:
            return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), double)
        exact = [_against_fixed(read(t.simpleString()), t, op, value) for t in _VARIANT_DECIMALS]
        return (
            F.when(kind == "BIGINT", _against_fixed(read("bigint"), T.LongType(), op, value))
            .when(kind.startswith("DECIMAL"), F.coalesce(*exact))
            .when(kind.isin("DOUBLE", "FLOAT"), double)
        )
    if isinstance(found.type, (T.IntegralType, T.DecimalType)) and whole:
        return _against_fixed(found.column, found.type, op, value)
    if isinstance(found.type, T.NumericType):
        return _against_double(found.column.cast("double"), op, value)
    return None


def _text(found: Field) -> Column | None:
    if isinstance(found.type, T.StringType):
        return found.column
    if isinstance(found.type, T.VariantType):
        is_text = F.schema_of_variant(found.column) == "STRING"
        return F.when(is_text, F.try_variant_get(found.column, "$", "string"))
    return None


def _equal(found: Field, value: object) -> Column | None:
    """NULL where the field is missing; None where the types cannot be equal."""
    if isinstance(value, (list, dict)):
        return None
    if _is_number(value):
        return _compare(found, "eq", value)
    if isinstance(value, bool):
        if isinstance(found.type, T.BooleanType):
            return found.column == F.lit(value)
        if isinstance(found.type, T.VariantType):
            is_bool = F.schema_of_variant(found.column) == "BOOLEAN"
            return F.when(is_bool, F.try_variant_get(found.column, "$", "boolean") == F.lit(value))
        return None
    if isinstance(found.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return found.column == F.lit(value).try_cast(found.type)
    text = _text(found)
    return None if text is None else text == F.lit(value)


def _leaf(op: str, found: Field | None, cond: dict) -> Column:
    value = cond.get("value")
    if op == "eq" and value is None:
        return F.lit(_TRUE) if found is None else found.column.isNull()
    if op == "ne" and value is None:
        return F.lit(_FALSE) if found is None else found.column.isNotNull()
    if found is None:
        return F.lit(op == "ne")
    if op in ("eq", "ne"):
        same = _equal(found, value)
        same = F.lit(_FALSE) if same is None else F.coalesce(same, F.lit(_FALSE))
        return ~same if op == "ne" else same
    if op in ("gt", "lt"):
        met = _compare(found, op, value) if _is_number(value) else None
        return F.lit(_FALSE) if met is None else F.coalesce(met, F.lit(_FALSE))
    text = _text(found)
    return F.lit(_FALSE) if text is None else search(text, cond["pattern"])


def condition(cond: dict, schema: T.StructType) -> Column:
    """Compile one condition tree against the columns of ``schema``."""
    op = cond["op"]
    if op == "and":
        return all_of(cond["conditions"], schema)
    if op == "or":
        parts = [condition(c, schema) for c in cond["conditions"]]
        return reduce(lambda a, b: a | b, parts, F.lit(_FALSE))
    if op == "not":
        return ~condition(cond["condition"], schema)
    if op in ("eq", "ne", "gt", "lt", "regex"):
        return _leaf(op, resolve(schema, cond["field"]), cond)
    raise ValueError(f"unknown condition op: {op}")


def all_of(conditions: list[dict], schema: T.StructType) -> Column:
    """Conjunction; an empty list holds for every row."""
    parts = [condition(c, schema) for c in conditions]
    return reduce(lambda a, b: a & b, parts, F.lit(_TRUE))


def holds(text: str) -> Column:
    """A free Spark SQL predicate, two-valued: NULL counts as not met."""
    return F.coalesce(F.expr(text), F.lit(_FALSE))
