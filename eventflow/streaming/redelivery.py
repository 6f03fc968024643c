"""Time limits, redelivery and fallback of a step in a stream.

Events wait in state until the watermark has passed them and are then taken in the order of
their time, so the outcome does not depend on the order of arrival and equals
``operators.redelivery.outcomes``. Event-time timers speak for answers that did not come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventflow.operators.redelivery import Outcome, Policy, State, apply, ordered_kind, outcome_schema, until

_EVENT = T.StructType(
    [T.StructField("at_us", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())]
)
_STATE = T.StructType([T.StructField("waiting", T.BooleanType()), T.StructField("attempt", T.LongType()), T.StructField("mark", T.LongType())])


def _millis(at_us: int) -> int:
    """The first millisecond after a time; a timer for it fires once the watermark has passed the time."""
    return at_us // 1000 + 1


class Steps(StatefulProcessor):
    """One message: the events the watermark has not passed yet, and the state of its step."""

    def __init__(self, policy: Policy, columns: list[str]):
        self.policy, self.columns = policy, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", _EVENT)
        self.step = handle.getValueState("step", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            given = [(int(a), int(n), k, p) for a, n, k, p in zip(batch["at_us"], batch["kind_no"], batch["kind"], batch["payload"])]
            self.coming.appendList(given)
            for at in {_millis(e[0]) for e in given}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # As far as the watermark has come: what follows from a timer may lie before it too.
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        coming = [tuple(e) for e in self.coming.get()] if self.coming.exists() else []
        now = sorted((e for e in coming if _millis(e[0]) <= due), key=lambda e: (e[0], e[1], e[3] is not None, e[3] or ""))
        known = self.step.get() if self.step.exists() else None
        state = None if known is None else State(bool(known[0]), int(known[1]), int(known[2]))
        out: list[Outcome] = []
        for at, _, kind, payload in now:
            state = apply(state, at, kind, payload, self.policy, out)
        # Whatever lies before this millisecond has happened.
        state = until(state, due * 1000 - 1, self.policy, out)
        while state is not None and _millis(state.mark) <= due:
            state = until(state, state.mark + 1, self.policy, out)
        if len(now) < len(coming):
            if now:
                self.coming.put([e for e in coming if _millis(e[0]) > due])
        elif coming:
            self.coming.clear()
        if state is None:
            if known is not None:
                self.step.clear()
        else:
            self.step.update(tuple(state))
            self.handle.registerTimer(_millis(state.mark))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.columns)

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, policy: Policy, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """The outcomes of ``operators.redelivery.outcomes`` for a stream whose ``ts`` carries a watermark.

    A row comes out once the watermark has passed its time; state of closed messages is gone.
    """
    timed = events.select(id_col, ts, F.unix_micros(ts).alias("at_us"), ordered_kind().alias("kind_no"), "kind", "payload")
    schema = outcome_schema(events.schema[id_col].dataType, id_col)
    done = timed.groupBy(id_col).transformWithStateInPandas(
        statefulProcessor=Steps(policy, schema.names), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return done.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")
