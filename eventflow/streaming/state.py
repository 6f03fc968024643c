"""Keyed state: review lifecycle, conversation memory, throttling.

Each processor sorts what one trigger brings for a key, so a trigger's size
(``read_stream(batch_size=..)``) bounds what a task holds. State is a counter,
a time, or ten turns per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventflow.operators.prompts import HISTORY
from eventflow.operators.review import APPROVED, PENDING, REJECTED, TIMED_OUT, ReviewConfig

_LONG, _TEXT = T.LongType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _gather(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class Reviews(StatefulProcessor):
    """One review: opened by a request, closed by decisions or by its deadline.

    Decisions that come before their request wait until it comes, or until the
    watermark has passed them.
    """

    def __init__(self, config: ReviewConfig, order: list[str], reviewer: T.DataType):
        self.config, self.order, self.reviewer = config, order, reviewer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.review = handle.getValueState("review", _struct(opened=_LONG, deadline=_LONG, approvals=_LONG, open=T.BooleanType()))
        self.early = handle.getListState("early", _struct(at_us=_LONG, decision=_TEXT, reviewer=self.reviewer))

    def _row(self, key, status: str, at_us: int, reviewer=None) -> dict:
        return {"review_id": key[0], "status": status, "at_us": at_us, "reviewer": reviewer}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.review.get() if self.review.exists() else None
        waiting = [tuple(r) for r in self.early.get()] if self.early.exists() else []
        given, out = [], []
        for row in _gather(rows, self.order).itertuples(index=False):
            if row.kind != "request":
                given.append((int(row.at_us), row.decision, None if pd.isna(row.reviewer) else row.reviewer))
            elif known is None:
                opened = int(row.at_us)
                known = (opened, opened + self.config.timeout_seconds * 1_000_000, 0, True)
                self.handle.registerTimer(known[1] // 1000 + 1)
                out.append(self._row(key, PENDING, opened))
        if known is None:
            for at, _, _ in given:
                self.handle.registerTimer(at // 1000 + 1)
            self.early.put(waiting + given)
            return
        opened, deadline, approvals, is_open = known
        for at, decision, reviewer in sorted(waiting + given, key=lambda d: d[0]):
            if not is_open or not opened <= at <= deadline:
                out.append(self._row(key, "not_found", at, reviewer))
                continue
            approvals += decision == APPROVED
            if approvals >= self.config.required_approvals or decision == REJECTED:
                is_open = False
                status = APPROVED if approvals >= self.config.required_approvals else REJECTED
                out.append(self._row(key, status, at, reviewer))
        self.early.clear()
        self.review.update((opened, deadline, int(approvals), is_open))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.review.exists():
            _, deadline, _, is_open = self.review.get()
            if deadline // 1000 + 1 <= due:
                self.review.clear()
                if is_open:
                    yield pd.DataFrame([self._row(key, TIMED_OUT, deadline)])
        elif self.early.exists():
            waiting = [tuple(r) for r in self.early.get()]
            past = [r for r in waiting if r[0] // 1000 + 1 <= due]
            if len(past) < len(waiting):
                self.early.put([r for r in waiting if r[0] // 1000 + 1 > due])
            else:
                self.early.clear()
            if past:
                yield pd.DataFrame([self._row(key, "not_found", at, reviewer) for at, _, reviewer in past])

    def close(self) -> None:
        pass


def reviews(df: DataFrame, config: ReviewConfig, ts: str = "ts", tie: list[str] = ()) -> DataFrame:
    """Status changes of reviews, from one stream of requests and decisions.

    Columns in: ``review_id``, ``kind`` (``request`` or ``decision``), ``reviewer``,
    ``decision``, and the watermarked ``ts``. Ids may be numbers or texts. A review that
    timed out comes out once the watermark has passed its deadline.
    """
    timed = df.withColumn("at_us", F.unix_micros(ts)).withColumn("kind_no", F.when(F.col("kind") == "request", 0).otherwise(1))
    ids = {c: df.schema[c].dataType for c in ("review_id", "reviewer")}
    processor = Reviews(config, ["at_us", "kind_no", *tie], ids["reviewer"])
    output = _struct(review_id=ids["review_id"], status=_TEXT, at_us=_LONG, reviewer=ids["reviewer"])
    changes = timed.groupBy("review_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )
    return changes.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def open_reviews(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The reviews a stream currently waits for, read from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "review").load()
    return state.where("value.open").select(
        F.col("key.review_id").alias("review_id"),
        F.timestamp_micros("value.deadline").alias("deadline"),
        F.col("value.approvals").alias("approvals"),
    )


class Memory(StatefulProcessor):
    """The latest turns of one conversation."""

    def __init__(self, key: str, order: str, size: int):
        self.key, self.order, self.size = key, order, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", _struct(role=_TEXT, content=_TEXT))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        ids, histories = [], []
        for row in _gather(rows, [self.order]).itertuples(index=False):
            kept = [*kept, (row.role, row.content)][-self.size :]
            ids.append(getattr(row, self.order))
            histories.append([{"role": r, "content": c} for r, c in kept])
        self.turns.put(kept)
        yield pd.DataFrame({self.key: key[0], self.order: ids, "history": histories})

    def close(self) -> None:
        pass


def memory(df: DataFrame, key: str, order: str, size: int = HISTORY) -> DataFrame:
    """The last ``size`` turns after each turn. Columns in: key, order, ``role``, ``content``."""
    turn = T.ArrayType(_struct(role=_TEXT, content=_TEXT))
    schema = _struct(**{key: df.schema[key].dataType, order: df.schema[order].dataType, "history": turn})
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Memory(key, order, size), outputStructType=schema, outputMode="Append", timeMode="None"
    )


class Throttle(StatefulProcessor):
    """When a message of this key last passed."""

    def __init__(self, ttl_us: int | None, columns: list[str], order: list[str], expire: bool):
        self.ttl_us, self.columns, self.order, self.expire = ttl_us, columns, order, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", _struct(at=_LONG))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.passed.get()[0] if self.passed.exists() else None
        pdf = _gather(rows, self.order)
        keep = []
        for at in pdf["at_us"]:
            fresh = last is None or (self.ttl_us is not None and at > last + self.ttl_us)
            last = int(at) if fresh else last
            keep.append(fresh)
        self.passed.update((last,))
        if self.expire and any(keep):
            self.handle.registerTimer((last + self.ttl_us) // 1000 + 1)
        yield pdf.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the time-to-live: whatever comes next passes anyway."""
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.passed.exists() and (self.passed.get()[0] + self.ttl_us) // 1000 + 1 <= due:
            self.passed.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle(
    df: DataFrame, key: str, ttl_seconds: float | None, ts: str = "ts", tie: list[str] = (), expire: bool = False
) -> DataFrame:
    """At most one message per key and time-to-live, in a stream.

    With ``expire`` a key's state is dropped once the watermark, which ``ts``
    must then carry, shows that it can no longer hold anything back.
    """
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1_000_000)
    if expire and ttl is None:
        raise ValueError("without a time-to-live nothing ever expires")
    processor = Throttle(ttl, df.columns, ["at_us", *tie], expire)
    return (
        df.withColumn("at_us", F.unix_micros(ts))
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=df.schema,
            outputMode="Append",
            timeMode="EventTime" if expire else "None",
        )
    )
