"""Field and row validation as one error column, and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions.arrays import pick
from eventflow.functions.conditions import holds
from eventflow.functions.json_text import is_json, unknown_keys
from eventflow.functions.paths import Field, resolve
from eventflow.functions.patterns import search

# The message of each kind of error.
MESSAGES = {
    "schema_validation": "Schema validation failed: {0}",
    "field_validation": "Field validation failed for '{0}': {1}",
    "missing_field": "Missing required field: {0}",
    "invalid_type": "Invalid type for field '{0}': expected {1}, got {2}",
    "custom": "Validation error: {0}",
}

_CASTS = {"number": "double", "integer": "bigint", "boolean": "boolean"}


@dataclass(frozen=True)
class FieldRule:
    """What one field must satisfy; absent settings check nothing."""

    required: bool = False
    type: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed_values: tuple = ()
    custom_validator: str | None = None


@dataclass(frozen=True)
class Rules:
    """Rules per field, and row-level rules.

    A row-level rule is ``{"custom": "<Spark SQL>"}``, ``{"not": rule}``,
    ``{"all": [rules]}`` or ``{"any": [rules]}``.
    """

    fields: dict[str, FieldRule] = field(default_factory=dict)
    row: tuple[dict, ...] = ()


def _error(kind: str, name: str | None, *parts: str | Column) -> Column:
    """A ``{kind, field, message}`` struct; message parts may be columns."""
    pieces: list[Column] = []
    text = MESSAGES[kind]
    for i, part in enumerate(parts):
        before, text = text.split("{%d}" % i, 1)
        pieces += [F.lit(before), part if isinstance(part, Column) else F.lit(part)]
    message = F.concat(*pieces, F.lit(text))
    return F.struct(F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("field"), message.alias("message"))


def _json_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "string"


def _variant_type(c: Column) -> Column:
    kind = F.schema_of_variant(c)
    return (
        F.when(kind == "BIGINT", "integer")
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("string")
    )


# A test that tells a bad row, and the error it then gets.
Failure = tuple[Column, Column]


def _type_error(name: str, found: Field, expected: str) -> Failure | None:
    """Declared types are checked once; texts and variants row by row."""
    if isinstance(found.type, T.VariantType):
        actual = _variant_type(found.column)
        fits = (actual == expected) | ((actual == "integer") & F.lit(expected == "number"))
        return found.column.isNotNull() & ~fits, _error("invalid_type", name, name, expected, actual)
    actual = _json_type(found.type)
    if actual == expected or (actual == "integer" and expected == "number"):
        return None
    if actual == "string" and expected in _CASTS:
        wrong = found.column.isNotNull() & found.column.try_cast(_CASTS[expected]).isNull()
        return wrong, _error("invalid_type", name, name, expected, actual)
    return found.column.isNotNull(), _error("invalid_type", name, name, expected, actual)


def _field_errors(name: str, rule: FieldRule, schema: T.StructType) -> list[Failure]:
    found = resolve(schema, name)
    if found is None:
        return [(F.lit(True), _error("missing_field", name, name))] if rule.required else []
    c, errors = found.column, []
    if rule.required:
        errors.append((c.isNull(), _error("missing_field", name, name)))
    if rule.type is not None:
        errors.append(_type_error(name, found, rule.type))

    def fails(ok: Column, reason: str) -> None:
        bad = c.isNotNull() & ~F.coalesce(ok, F.lit(False))
        errors.append((bad, _error("field_validation", name, name, reason)))

    size = F.size(c) if isinstance(found.type, T.ArrayType) else F.length(c.cast("string"))
    if rule.min_length is not None:
        fails(size >= rule.min_length, f"shorter than {rule.min_length}")
    if rule.max_length is not None:
        fails(size <= rule.max_length, f"longer than {rule.max_length}")
    if rule.pattern is not None:
        fails(search(c.cast("string"), rule.pattern), "does not match pattern")
    if rule.allowed_values:
        values = [F.lit(v) if isinstance(found.type, T.VariantType) else F.lit(v).cast("string").try_cast(found.type) for v in rule.allowed_values]
        fails(c.isin(*values), "value not allowed")
    if rule.custom_validator is not None:
        fails(F.expr(rule.custom_validator), "custom validator failed")
    return [e for e in errors if e is not None]


def row_rule(rule: dict) -> Column:
    """A row-level rule tree as one two-valued column."""
    (kind, body), = rule.items()
    if kind == "custom":
        return holds(body)
    if kind == "not":
        return ~row_rule(body)
    parts = [row_rule(r) for r in body]
    if kind == "all":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if kind == "any":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    raise ValueError(f"unknown row rule: {kind}")


def _label(rule: dict) -> str:
    (kind, body), = rule.items()
    return body if kind == "custom" else f"{kind} rule not met"


_ERROR = "struct<kind:string,field:string,message:string>"


def validation_errors(rules: Rules, schema: T.StructType) -> Column:
    """All errors of a row as an array; empty where the row is valid."""
    found: list[Failure] = []
    for name, rule in rules.fields.items():
        found += _field_errors(name, rule, schema)
    for rule in rules.row:
        found.append((~row_rule(rule), _error("custom", None, _label(rule))))
    return pick(found, _ERROR)


def strict_schema_errors(payload: Column, known: list[str]) -> Column:
    """One error per key of a JSON payload that the schema does not declare; one for a payload that is no JSON."""
    extra = F.array_sort(unknown_keys(payload, known))
    unknown = F.transform(
        extra, lambda k: _error("schema_validation", None, F.concat(F.lit("unknown field "), k))
    ).cast(f"array<{_ERROR}>")
    malformed = F.array(_error("schema_validation", None, "invalid JSON")).cast(f"array<{_ERROR}>")
    return F.when(is_json(payload), unknown).otherwise(malformed)


def validate(df: DataFrame, rules: Rules, into: str = "errors") -> DataFrame:
    return df.withColumn(into, validation_errors(rules, df.schema))


def is_valid(errors: str = "errors") -> Column:
    return F.size(errors) == 0


def messages(errors: str = "errors", separator: str = "; ") -> Column:
    return F.array_join(F.col(errors).getField("message"), separator)


def split(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows, for consumers that need only one of them."""
    return df.where(is_valid(errors)).drop(errors), df.where(~is_valid(errors))


def route_errors(df: DataFrame, output_topic: str, error_topic: str, original: str, errors: str = "errors") -> DataFrame:
    """Accepted and rejected rows in one pass: columns ``topic`` and ``payload``.

    A rejected payload becomes ``{"error": .., "original_message": ..}``.
    """
    failed = F.to_json(F.struct(messages(errors).alias("error"), F.col(original).alias("original_message")))
    return df.withColumns(
        {
            "topic": F.when(is_valid(errors), F.lit(output_topic)).otherwise(F.lit(error_topic)),
            "payload": F.when(is_valid(errors), F.col(original)).otherwise(failed),
        }
    )


def acknowledgement(schema_name: str, rules_name: str, errors: str = "errors") -> Column:
    """Reply per message: ``{status, schema, rules, error}``."""
    ok = is_valid(errors)
    return F.struct(
        F.when(ok, "processed").otherwise("error").alias("status"),
        F.when(ok, F.lit(schema_name)).alias("schema"),
        F.when(ok, F.lit(rules_name)).alias("rules"),
        F.when(~ok, messages(errors)).alias("error"),
    )


def conforms(df: DataFrame, declared: T.StructType, into: str = "errors") -> DataFrame:
    """Check results against an agent's output schema: nullability, types and presence."""
    fields = {f.name: FieldRule(required=not f.nullable, type=_json_type(f.dataType)) for f in declared.fields}
    return validate(df, Rules(fields=fields), into)
