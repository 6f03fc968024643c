"""JSON payloads: strict decoding with the bad rows kept, and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_corrupt_record"


def utf8(payload: Column, lossy: bool = False) -> Column:
    """Bytes to text: NULL for malformed bytes, or repaired text if ``lossy``."""
    text = payload.cast("string")
    return F.make_valid_utf8(text) if lossy else F.try_validate_utf8(text)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def decode(df: DataFrame, schema: T.StructType, payload: str = "payload", into: str = "body") -> DataFrame:
    """Add ``into`` (struct, NULL if malformed) and ``decode_error`` (text or NULL)."""
    source = F.col(payload)
    if isinstance(df.schema[payload].dataType, T.BinaryType):
        source = utf8(source)
    wide = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = df.withColumn("__parsed", F.from_json(source, wide, options))
    ok = F.col("__parsed").isNotNull() & F.col(f"__parsed.{_BAD}").isNull()
    body = F.struct(*[F.col(f"__parsed.`{f.name}`").alias(f.name) for f in schema.fields])
    return (
        parsed.withColumn(into, F.when(ok, body))
        .withColumn("decode_error", F.when(~ok, F.lit("invalid JSON payload")))
        .drop("__parsed")
    )


def encode(*columns: Column) -> Column:
    """JSON text of an object built from aliased columns."""
    return F.to_json(F.struct(*columns))


def unknown_keys(payload: Column, known: list[str]) -> Column:
    """Top-level keys of a JSON object that a strict schema does not list."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.array_except(keys, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
