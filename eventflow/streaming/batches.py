"""Micro-batches in a stream: closed by size or by a pause, whichever comes first.

Messages wait in state until the watermark has passed them, so batches are those of
``operators.batches.micro_batches`` on the same messages, however they arrive. A full batch
leaves at once; a timer closes one that no further message reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventflow.operators.batches import BATCH_SIZE, IDLE_SECONDS

_LONG = T.LongType()


def _millis(at_us: int) -> int:
    """The first millisecond after a time."""
    return at_us // 1000 + 1


class MicroBatches(StatefulProcessor):
    """One key: messages the watermark has not passed, the open batch, and where the numbering stands."""

    def __init__(self, size: int, idle_us: int, item: T.DataType, columns: list[str]):
        self.size, self.idle_us, self.item, self.columns = size, idle_us, item, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        message = T.StructType([T.StructField("at_us", _LONG), T.StructField("item", self.item)])
        self.coming = handle.getListState("coming", message)
        self.open = handle.getListState("open", message)
        numbers = ("session", "batch", "last")
        self.place = handle.getValueState("place", T.StructType([T.StructField(n, _LONG) for n in numbers]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            given = [(int(at), item) for at, item in zip(batch["at_us"], batch["item"])]
            self.coming.appendList(given)
            for at in {_millis(at) for at, _ in given}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        coming = [tuple(m) for m in self.coming.get()] if self.coming.exists() else []
        filled = [tuple(m) for m in self.open.get()] if self.open.exists() else []
        session, number, last = (int(x) for x in self.place.get()) if self.place.exists() else (0, 0, None)
        now = sorted((m for m in coming if _millis(m[0]) <= due), key=lambda m: (m[0], m[1] is not None, m[1]))
        had, out = bool(filled), []

        def close(by: str) -> None:
            nonlocal filled, number
            out.append((key[0], session, number, len(filled), filled[0][0], filled[-1][0], by, [item for _, item in filled]))
            filled, number = [], number + 1

        for at, item in now:
            if last is None or at - last > self.idle_us:
                if filled:
                    close("pause")
                session, number = session + 1, 0
            filled.append((at, item))
            last = at
            if len(filled) == self.size:
                close("size")
        if filled and _millis(last + self.idle_us) <= due:
            close("pause")
        if now:
            rest = [m for m in coming if _millis(m[0]) > due]
            if rest:
                self.coming.put(rest)
            else:
                self.coming.clear()
        if filled:
            self.open.put(filled)
            self.handle.registerTimer(_millis(last + self.idle_us))
        elif had:
            self.open.clear()
        if now or out:
            self.place.update((session, number, last))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def micro_batches(
    df: DataFrame, key: str, item: str, ts: str = "ts", size: int = BATCH_SIZE, idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """One row per batch of a stream whose ``ts`` carries a watermark.

    Columns out: the key, session (1, 2, .. per key), batch (from 0), n, opened and closed
    (times of the first and last message), closed_by (``size`` or ``pause``), items (the
    ``item`` column in order of time, then of the items, NULL first).
    """
    item_type = df.schema[item].dataType
    fields = [(key, df.schema[key].dataType), ("session", _LONG), ("batch", _LONG), ("n", _LONG), ("opened_us", _LONG), ("closed_us", _LONG)]
    fields += [("closed_by", T.StringType()), ("items", T.ArrayType(item_type))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    timed = df.select(key, ts, F.unix_micros(ts).alias("at_us"), F.col(item).alias("item"))
    processor = MicroBatches(size, int(idle_seconds * 1_000_000), item_type, schema.names)
    found = timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    times = {n: F.timestamp_micros(f"{n}_us").alias(n) for n in ("opened", "closed")}
    return found.select(key, "session", "batch", "n", *times.values(), "closed_by", "items")
