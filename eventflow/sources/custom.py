"""User-defined sources through Spark's Python data source API.

``TickSource`` is the example that ships: a timer as a batch or stream source.
Any other subclass of ``DataSource`` registers the same way.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)


class _Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _rows(start: datetime, seconds: float, part: _Slice):
    for tick in range(part.first, part.last):
        yield (tick, start + timedelta(seconds=tick * seconds))


class TickSource(DataSource):
    """Options: ``start`` (ISO time), ``seconds`` between ticks, ``count``, ``parts``.

    As a stream it offers the ticks that are due by now, at most ``count`` of
    them, so a restarted query goes on where its checkpoint ended.
    """

    @classmethod
    def name(cls) -> str:
        return "ticks"

    def schema(self) -> str:
        return "tick_id bigint, tick timestamp"

    def _settings(self) -> tuple[datetime, float, int]:
        start = datetime.fromisoformat(self.options.get("start", "2024-01-01T00:00:00"))
        start = start if start.tzinfo else start.replace(tzinfo=timezone.utc)
        return start, float(self.options.get("seconds", 1)), int(self.options["count"])

    def reader(self, schema) -> DataSourceReader:
        return _TickReader(*self._settings(), int(self.options.get("parts", 8)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TickStream(*self._settings())


class _TickReader(DataSourceReader):
    def __init__(self, start, seconds, count, parts):
        self.start, self.seconds, self.count, self.parts = start, seconds, count, parts

    def partitions(self):
        edges = [self.count * i // self.parts for i in range(self.parts + 1)]
        return [_Slice(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition):
        return _rows(self.start, self.seconds, partition)


class _TickStream(DataSourceStreamReader):
    def __init__(self, start, seconds, count):
        self.start, self.seconds, self.count = start, seconds, count

    def initialOffset(self):
        return {"tick": 0}

    def latestOffset(self):
        elapsed = (datetime.now(timezone.utc) - self.start).total_seconds()
        due = max(0, int(elapsed // self.seconds) + 1)
        return {"tick": min(due, self.count)}

    def partitions(self, start, end):
        return [_Slice(start["tick"], end["tick"])]

    def read(self, partition):
        return _rows(self.start, self.seconds, partition)
