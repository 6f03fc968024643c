"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import eventflow

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Runtime settings only: safe to apply to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even if that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Keyed state with timers needs this store; it also keeps state off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; partition counts stay as the cluster set them.

    The package's Python functions travel inside the tasks, so executors need not
    have it installed.
    """
    cloudpickle.register_pickle_by_value(eventflow)
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventflow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that every executor can reach.

    Taken from ``spark.checkpoint.dir``. Only a local session may fall back to
    a temporary folder: on a cluster such a folder would exist on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="eventflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
