"""Resources addressed by URI: files are read and written, web URIs only recognised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The schemes a resource may be read from and written to.
READABLE = ("file", "http", "https")
WRITABLE = ("file",)

# Folder schemes of a cluster that stand in for ``file``.
SHARED_STORES = ("file", "hdfs", "s3a", "abfss", "gs")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def scheme(uri: Column) -> Column:
    """Lower-cased scheme of a URI, NULL if it has none."""
    found = F.lower(F.regexp_extract(uri, _SCHEME, 1))
    return F.when(found != "", found)


def dispatch(uri: Column) -> Column:
    """``{scheme, readable, writable, error}`` for each URI; bad rows do not fail."""
    name = scheme(uri)
    error = (
        F.when(name.isNull(), F.lit("invalid URI"))
        .when(~name.isin(*READABLE), F.concat(F.lit("unsupported scheme: "), name))
    )
    return F.struct(
        name.alias("scheme"),
        F.coalesce(name.isin(*READABLE), F.lit(False)).alias("readable"),
        F.coalesce(name.isin(*WRITABLE), F.lit(False)).alias("writable"),
        error.alias("error"),
    )


def _require_store(uri: str) -> None:
    name = uri.split(":", 1)[0].lower() if ":" in uri else "file"
    if name not in SHARED_STORES:
        raise ValueError(f"unsupported scheme: {name}")


def get(spark: SparkSession, uri: str, format: str = "binaryFile", **options) -> DataFrame:
    """Read a file or folder in any format Spark knows."""
    _require_store(uri)
    return spark.read.format(format).options(**options).load(uri)


def put(df: DataFrame, uri: str, format: str = "parquet", mode: str = "append") -> None:
    """Write a result; missing parent folders are created."""
    _require_store(uri)
    df.write.format(format).mode(mode).save(uri)
