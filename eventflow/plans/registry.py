"""Named queries over the table set, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from eventflow.session import configure


class Tables:
    """The tables of one folder, read when asked for: ``t.events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return register
