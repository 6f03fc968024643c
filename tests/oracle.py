"""Compare a Spark result with the SQL text run by DuckDB: names, kinds, values."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(type_name: str) -> str:
    text = type_name.lower().split("(")[0]
    groups = {
        "int": ("bigint", "int", "integer", "long", "smallint", "tinyint"),
        "float": ("double", "float"),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
        "time": ("timestamp", "timestamp_ntz"),
    }
    for kind, names in groups.items():
        if text in names:
            return kind
    return text


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    result = con.execute(sql)
    theirs = {d[0]: _kind(str(d[1])) for d in result.description}
    expected = _rows(list(theirs), result.fetchall())
    ours = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema}
    if ours != theirs:
        return f"columns differ: {ours} / {theirs}"
    got = _rows(spark_df.columns, spark_df.collect())
    if len(got) != len(expected):
        return f"row counts differ: {len(got)} / {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"first difference: {a} / {b}"
    return None
