"""Steps that fail or never answer: time limits, redelivery with growing pauses, and what comes after the last try.

A request opens a step. Its result closes it; a failure, or no answer within the time
limit, uses up one try. While tries are left the message waits and is delivered again, the
pause growing from try to try; after the last one it is rejected, or goes to the fallback.
``apply`` and ``until`` are the rules for one message; the batch form and the
stream (``streaming.redelivery``) both follow them, in the order of event time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST, RESULT, FAILURE = "request", "result", "failure"
KINDS = (REQUEST, RESULT, FAILURE)
OK, RETRY, DELIVER, GIVEN_UP, NOT_FOUND, LATE, REPEATED = "ok", "retry", "deliver", "given_up", "not_found", "late", "repeated"
FOREVER = 1 << 62


@dataclass(frozen=True)
class Policy:
    """``retries`` deliveries after the first; the pause before the n-th is ``delay * growth ** (n - 1)``, at most ``longest``."""

    timeout_seconds: float
    retries: int = 0
    delay_seconds: float = 0.0
    growth: float = 2.0
    longest_seconds: float = 86_400.0

    def pause_us(self, attempt: int) -> int:
        return int(min(self.delay_seconds * self.growth ** (attempt - 1), self.longest_seconds) * 1_000_000)

    @property
    def timeout_us(self) -> int:
        return int(self.timeout_seconds * 1_000_000)


class State(NamedTuple):
    """An open step: ``waiting`` for its answer until ``mark``, or pausing until ``mark``."""

    waiting: bool
    attempt: int
    mark: int


class Outcome(NamedTuple):
    status: str
    attempt: int
    at_us: int
    reason: str | None = None
    payload: str | None = None


def _failed(state: State, at: int, reason: str, payload: str | None, policy: Policy) -> tuple[State | None, Outcome]:
    if state.attempt > policy.retries:
        return None, Outcome(GIVEN_UP, state.attempt, at, reason, payload)
    pausing = State(False, state.attempt, at + policy.pause_us(state.attempt))
    return pausing, Outcome(RETRY, state.attempt, at, reason, payload)


def until(state: State | None, now: int, policy: Policy, out: list[Outcome]) -> State | None:
    """What happens by itself before an event at ``now``: time limits that have passed, pauses that have ended."""
    while state is not None and (state.mark < now or (state.mark == now and not state.waiting)):
        if state.waiting:
            state, outcome = _failed(state, state.mark, "timed_out", None, policy)
        else:
            outcome = Outcome(DELIVER, state.attempt + 1, state.mark)
            state = State(True, state.attempt + 1, state.mark + policy.timeout_us)
        out.append(outcome)
    return state


def apply(state: State | None, at: int, kind: str, payload: str | None, policy: Policy, out: list[Outcome]) -> State | None:
    """One event; an answer at the very end of the time limit is in time."""
    state = until(state, at, policy, out)
    if kind == REQUEST:
        if state is None:
            return State(True, 1, at + policy.timeout_us)
        out.append(Outcome(REPEATED, state.attempt, at, None, payload))
    elif state is None:
        out.append(Outcome(NOT_FOUND, 0, at, kind, payload))
    elif not state.waiting:
        out.append(Outcome(LATE, state.attempt, at, kind, payload))
    elif kind == RESULT:
        out.append(Outcome(OK, state.attempt, at, None, payload))
        return None
    else:
        state, outcome = _failed(state, at, kind, payload, policy)
        out.append(outcome)
    return state


def follow(events: Iterable[tuple[int, str, str | None]], policy: Policy) -> list[Outcome]:
    """All outcomes of one message whose events (time, kind, payload) come in order."""
    out: list[Outcome] = []
    state = None
    for at, kind, payload in events:
        state = apply(state, at, kind, payload, policy, out)
    until(state, FOREVER, policy, out)
    return out


def outcome_schema(id_type: T.DataType, id_col: str) -> T.StructType:
    fields = [(id_col, id_type), ("status", T.StringType()), ("attempt", T.LongType()), ("at_us", T.LongType()), ("reason", T.StringType()), ("payload", T.StringType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def ordered_kind(kind: str = "kind") -> Column:
    """At one time a request comes before answers, a result before a failure."""
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)).cast("int")


def outcomes(events: DataFrame, policy: Policy, id_col: str = "id", ts: str = "ts") -> DataFrame:
    """What becomes of every message: id, status, attempt, at, reason, payload.

    Columns in: the id, ``kind`` (request, result or failure), ``payload`` (text) and the
    time. A status is ``ok``, ``retry`` (a try is used up), ``deliver`` (the message is due
    again), ``given_up`` (no try left), ``late`` (an answer during the pause), ``not_found`` (an answer without an
    open step) or ``repeated`` (a request of an open step). All time limits run out at the end.
    The events are sorted by Spark and read one at a time; a message has few. A NULL id is an id.
    """
    timed = events.select(id_col, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), ordered_kind().alias("kind_no"), "kind", "payload")
    schema = outcome_schema(events.schema[id_col].dataType, id_col)
    ordered = timed.repartition(id_col).sortWithinPartitions(id_col, "at_us", "kind_no", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, now, state = False, None, None

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=schema.names, dtype=object)

        for batch in batches:
            rows: list[tuple] = []
            batch = batch.astype(object).where(batch.notna(), None)
            for key, at, kind, payload in zip(batch[id_col], batch["at_us"], batch["kind"], batch["payload"]):
                out: list[Outcome] = []
                if begun and key != now:
                    until(state, FOREVER, policy, out)
                    rows += [(now, *o) for o in out]
                    state, out = None, []
                begun, now = True, key
                state = apply(state, int(at), kind, payload, policy, out)
                rows += [(key, *o) for o in out]
            yield frame(rows)
        out = []
        until(state, FOREVER, policy, out)
        yield frame([(now, *o) for o in out])

    done = ordered.mapInPandas(run, schema)
    return done.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def topic(ok: str, retry: str, reject: str) -> Column:
    """Where an outcome goes: results, messages set aside for another try, messages given up."""
    return F.when(F.col("status") == OK, ok).when(F.col("status").isin(RETRY, DELIVER), retry).when(F.col("status") == GIVEN_UP, reject)


def handled_by() -> Column:
    """``primary`` for results of the step, ``fallback`` for messages that were given up."""
    return F.when(F.col("status") == OK, "primary").when(F.col("status") == GIVEN_UP, "fallback")
