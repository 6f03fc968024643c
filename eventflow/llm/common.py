"""What the operators share: session settings, intermediate tables, per-worker stores, safe column names."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.session import configure, shared_folder

#: Rows and bytes that one Arrow batch hands to Python, so that long texts stay in bounds.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe against lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column of that name (in any case) exists."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> list[Column]:
    """A row's id and a hash of its text: rows that agree in both are repeats of one row."""
    return [F.col(id_col), F.xxhash64(text_of(text_col))]


def worker_store(name: str) -> dict:
    """A dictionary that outlives the task, until the worker process asks for another one.

    The package's functions travel by value, so their module globals are new in
    each task; what is dear to build (vocabularies, memo tables) is kept here. Only
    one is kept, so that the steps of a long job don't add up in a worker's memory.
    """
    module = sys.modules.setdefault("eventflow_worker_store", types.ModuleType("eventflow_worker_store"))
    if getattr(module, "held", None) != name:
        module.held, module.store = name, {}
    return module.store
