"""Intermediate tables in the shared folder: computed once, read by several steps, safe against lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from eventflow.session import shared_folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under a new name and read back, so its size is known and its lineage is short.

    The folder is the caller's to clear once the results are used.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
