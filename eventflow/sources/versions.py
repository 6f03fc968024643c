"""Reference data that changes: the version valid at a row's time, and snapshots refreshed by lifetime."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventflow.functions.arrays import last_at_most
from eventflow.operators.ordered import PART, across, parted

from .context import lookup


def as_of(
    df: DataFrame, versions: DataFrame, on: list[str], at: str, valid_from: str, chunk: str = "day",
    ttl: timedelta | None = None, into: str = "version",
) -> DataFrame:
    """Add ``into``: the columns of the newest version of the row's key that began at or before its time ``at``.

    It is NULL where there is none, where the key or the time is NULL, and where the version is
    older than ``ttl``. Of several versions of a key from one time the greatest row counts;
    a version without key or time is never valid. Every row of ``df`` comes out once.

    No key is gathered in one task: rows and versions are put in order per key and
    ``chunk`` (a unit of ``date_trunc``), and a chunk gets the last version before it as one row.
    """
    rest = [c for c in versions.columns if c not in on]
    newest = F.struct(valid_from, *[c for c in rest if c != valid_from])
    known = versions.dropna(subset=[*on, valid_from]).groupBy(*on, valid_from).agg(F.max(newest).alias("__version"))
    rows = df.select(F.struct(*df.columns).alias("__row"), *on, F.col(at).alias("__at"), F.lit(1).alias("__kind"))
    marks = known.select("__version", *on, F.col(valid_from).alias("__at"), F.lit(0).alias("__kind"))
    mixed = parted(rows.unionByName(marks, allowMissingColumns=True), on, F.date_trunc(chunk, "__at"))

    begun = F.max(F.when(F.col("__kind") == 0, F.struct("__at", "__version")))["__version"]
    before = across().rowsBetween(Window.unboundedPreceding, -1)
    carried = mixed.groupBy(PART).agg(begun.alias("__last")).select(PART, F.last("__last", True).over(before).alias("__carry"))
    within = Window.partitionBy(PART).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    local = mixed.withColumn("__own", F.last("__version", True).over(within)).where(F.col("__kind") == 1)

    found = F.when(F.col("__at").isNotNull(), F.coalesce("__own", "__carry"))
    if ttl is not None:
        found = F.when(F.col("__at") <= found[valid_from] + F.lit(ttl), found)
    return local.join(carried, on=PART).select("__row.*", found.alias(into))


class Snapshots:
    """A resource kept as dated snapshots in a shared folder, loaded anew once the newest is older than its lifetime.

    ``refresh`` goes at the start of a trigger, ``lookup`` then gives each row the snapshot that
    was the newest at the row's time, so a batch that is run again after a refresh
    gets what it got before. The folder is the caller's to clear.
    """

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], DataFrame], ttl: timedelta):
        self.spark, self.path, self.load, self.ttl = spark, path.rstrip("/"), load, ttl
        self.versions = self._listed()

    def _listed(self) -> list[datetime]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        system = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not system.exists(folder):
            return []
        # A snapshot counts once its write has ended.
        names = [s.getPath() for s in system.listStatus(folder)]
        done = [p.getName() for p in names if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(datetime.fromtimestamp(int(name.split("=")[1]) / 1e6, timezone.utc) for name in done)

    def refresh(self, now: datetime | None = None) -> bool:
        """Load a snapshot if there is none within its lifetime; True if one was loaded."""
        now = now or datetime.now(timezone.utc)
        if self.versions and now - self.versions[-1] <= self.ttl:
            return False
        name = f"snapshot={round(now.timestamp() * 1e6)}"
        self.load().write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        self.versions = self._listed()
        return True

    def lookup(self, df: DataFrame, on: list[str], at: str) -> DataFrame:
        """Enrich rows by key from the newest snapshot at or before their time ``at``; NULLs before the first one."""
        micros = [round(v.timestamp() * 1e6) for v in self.versions]
        valid = last_at_most(micros, F.unix_micros(F.col(at).cast("timestamp")))
        data = self.spark.read.parquet(f"{self.path}/data").withColumn("snapshot", F.col("snapshot").cast("bigint"))
        used = data.where(F.col("snapshot").isin(micros)).withColumnRenamed("snapshot", "__snapshot")
        return lookup(df.withColumn("__snapshot", valid), used, [*on, "__snapshot"]).drop("__snapshot")
