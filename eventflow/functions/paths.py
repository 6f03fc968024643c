"""Field paths such as ``a.b.c``: resolved against a schema, null-safe."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A resolved path: the column that reads it and its declared type."""

    column: Column
    type: T.DataType


def resolve(schema: T.StructType, path: str) -> Field | None:
    """The field under a dotted or slashed path, or None if nothing declares it."""
    head, *rest = path.replace("/", ".").split(".")
    if head not in schema.names:
        return None
    found = Field(F.col(f"`{head}`"), schema[head].dataType)
    for position, name in enumerate(rest):
        kind = found.type
        if isinstance(kind, T.StructType) and name in kind.names:
            found = Field(found.column.getField(name), kind[name].dataType)
        elif isinstance(kind, T.MapType):
            found = Field(F.try_element_at(found.column, F.lit(name)), kind.valueType)
        elif isinstance(kind, T.VariantType):
            tail = ".".join(rest[position:])
            return Field(F.try_variant_get(found.column, f"$.{tail}", "variant"), kind)
        else:
            return None
    return found


def field(schema: T.StructType, path: str) -> Column:
    """Column of a path, NULL where the schema does not declare it."""
    found = resolve(schema, path)
    return found.column if found else F.lit(None)


def first_present(*columns: Column) -> Column:
    """``a ?? b ?? c``."""
    return F.coalesce(*columns)


def all_present(columns: list[Column]) -> Column:
    """True where every column has a value; true for an empty list."""
    return reduce(lambda acc, c: acc & c.isNotNull(), columns, F.lit(True))


def record(schema: T.StructType, mapping: dict[str, str]) -> Column:
    """Build an object from named paths: ``{k: path, ...}``."""
    return F.struct(*[field(schema, path).alias(name) for name, path in mapping.items()])
