"""Cleaning and unifying fields: text steps, features, dates, units, names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = " \t\n\x0b\f\r"
_SPECIAL = r"[^\p{L}\p{N}\s]+"

TEXT_STEPS = {
    "trim": lambda c: F.btrim(c, F.lit(_BLANKS)),
    "lowercase": F.lower,
    "uppercase": F.upper,
    "remove_special_chars": lambda c: F.regexp_replace(c, _SPECIAL, ""),
}

# Features that a feature list may name without spelling out an expression.
NAMED_FEATURES = {
    "tx_hour": lambda: F.hour("ts").cast("bigint"),
    "tx_weekday": lambda: F.dayofweek("ts").cast("bigint"),
    "is_foreign_country": lambda: F.col("country") != F.col("home_country"),
}


def clean_text(text: Column, steps: list[str]) -> Column:
    """Apply named text steps in order."""
    for step in steps:
        text = TEXT_STEPS[step](text)
    return text


def features(df: DataFrame, wanted: list[str], keep: list[str] = (), registry: dict | None = None) -> DataFrame:
    """Select features given as field names, known names, or ``"name: expression"``."""
    known = {**NAMED_FEATURES, **(registry or {})}
    chosen = []
    for entry in wanted:
        name, colon, text = entry.partition(":")
        name = name.strip()
        if colon:
            chosen.append(F.expr(text).alias(name))
        elif name in df.columns:
            chosen.append(F.col(name))
        else:
            chosen.append(known[name]().alias(name))
    return df.select(*keep, *chosen)


def parse_date(text: Column, formats: list[str]) -> Column:
    """The first format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def convert(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """Scale to the base unit; NULL for a unit without a factor."""
    pairs = [F.lit(x) for name, factor in factors.items() for x in (name, float(factor))]
    return value * F.try_element_at(F.create_map(*pairs), unit)


@dataclass(frozen=True)
class Normalization:
    """Settings of one normalizer; steps run in the order of the fields."""

    dates: dict[str, list[str]] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    text: dict[str, list[str]] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)


def normalize(df: DataFrame, config: Normalization) -> DataFrame:
    """Unify dates, scale units, clean texts, fill defaults, rename and drop fields."""
    changes: dict[str, Column] = {}
    for name, formats in config.dates.items():
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        changes[name] = parse_date(F.col(name), formats) if is_text else F.col(name).cast("timestamp")
    for name, factor in config.scale.items():
        changes[name] = F.col(name) * F.lit(float(factor))
    for name, steps in config.text.items():
        changes[name] = clean_text(F.col(name), steps)
    for name, value in config.defaults.items():
        changes[name] = F.coalesce(changes.get(name, F.col(name)), F.lit(value))
    return df.withColumns(changes).withColumnsRenamed(config.rename).drop(*config.drop)
