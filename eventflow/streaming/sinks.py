"""Starting streams and writing their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from eventflow.session import shared_folder


def checkpoint_for(spark: SparkSession, name: str) -> str:
    """Where the query of this name keeps offsets and state, for restarts on any executor."""
    return f"{shared_folder(spark).rstrip('/')}/streams/{name}"


def publish(df: DataFrame, root: str, name: str, checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Write rows with a ``topic`` column to one folder per topic, exactly once.

    A batch goes to ``<root>/batch=<id>/topic=<name>``. A batch that is run again
    after a failure replaces its own folder. Without ``every`` the query takes
    what is there and stops.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("topic").parquet(f"{root}/batch={batch_id}")

    writer = df.writeStream.queryName(name).foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint or checkpoint_for(df.sparkSession, name))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def append(df: DataFrame, path: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Write all rows to one folder with the file sink's own exactly-once log."""
    return (
        df.writeStream.queryName(name)
        .format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or checkpoint_for(df.sparkSession, name))
        .trigger(availableNow=True)
        .start()
    )


def finish(query: StreamingQuery, timeout_seconds: int | None = None) -> bool:
    """Wait for a bounded run; stop it after ``timeout_seconds``. True if it ended by itself."""
    ended = query.awaitTermination(timeout_seconds) if timeout_seconds else query.awaitTermination() or True
    if not ended:
        query.stop()
    return bool(ended)
