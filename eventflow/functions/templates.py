"""``{{name}}`` text templates, compiled once into a single string column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import resolve

_TAG = re.compile(r"\{\{\s*(#if\s+[\w./]+|/if|[\w./]+)\s*\}\}")


def _as_text(schema: T.StructType, path: str) -> Column:
    found = resolve(schema, path)
    if found is None:
        return F.lit("")
    if isinstance(found.type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return F.coalesce(F.to_json(found.column), F.lit(""))
    return F.coalesce(found.column.cast("string"), F.lit(""))


def _is_set(schema: T.StructType, path: str) -> Column:
    found = resolve(schema, path)
    if found is None:
        return F.lit(False)
    if isinstance(found.type, T.BooleanType):
        return F.coalesce(found.column, F.lit(False))
    return _as_text(schema, path) != ""


def render(template: str, schema: T.StructType) -> Column:
    """Substitute fields; NULL and undeclared names become empty text.

    ``{{#if x}} .. {{/if}}`` keeps its block where ``x`` is neither NULL, false
    nor empty. Blocks nest.
    """
    stack: list[tuple[Column | None, list[Column]]] = [(None, [])]
    parts = _TAG.split(template)
    for index, part in enumerate(parts):
        if index % 2 == 0:
            if part:
                stack[-1][1].append(F.lit(part))
        elif part.startswith("#if"):
            stack.append((_is_set(schema, part[3:].strip()), []))
        elif part == "/if":
            if len(stack) == 1:
                raise ValueError("{{/if}} without {{#if}}")
            test, block = stack.pop()
            stack[-1][1].append(F.when(test, F.concat(F.lit(""), *block)).otherwise(""))
        else:
            stack[-1][1].append(_as_text(schema, part))
    if len(stack) != 1:
        raise ValueError("{{#if}} without {{/if}}")
    return F.concat(F.lit(""), *stack[0][1])
