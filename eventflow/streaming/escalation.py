"""Reviews in a stream with escalation and reviewer policies.

A review is pending until its deadline, then goes through the escalation levels, each
with a deadline of its own, and ends in a last action. Who may approve, and whether all
named reviewers have to, is decided as in ``operators.review``. Events are taken in the
order of their time once the watermark has passed them, so the outcome equals the batch form's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventflow.operators.review import APPROVED, PENDING, REJECTED, TIMED_OUT, TOPIC_PART, ReviewConfig

ESCALATED, NOT_FOUND, IGNORED = "escalated", "not_found", "ignored"
_LAST = {"approve": APPROVED, "reject": REJECTED, "escalate": ESCALATED, "time_out": TIMED_OUT}


@dataclass(frozen=True)
class Level:
    """Where a review goes that nobody closed, and how long it may stay there."""

    topic: str
    timeout_seconds: float


@dataclass(frozen=True)
class Escalation:
    """The levels one after the other; ``last`` is what follows the last deadline: approve, reject, escalate or time_out."""

    levels: tuple[Level, ...] = ()
    last: str = "time_out"
    last_topic: str | None = None


@dataclass(frozen=True)
class Open:
    """A review that waits: its deadline, its level (0: pending), approvals so far, and who gave them."""

    deadline: int
    level: int = 0
    approvals: int = 0
    submitter: Any = None
    approved_by: tuple = ()


class Rules:
    """What an event, or a deadline, does to a review. Outcomes are (status, level, time, reviewer, topic, missing)."""

    def __init__(self, config: ReviewConfig, escalation: Escalation):
        self.config, self.escalation = config, escalation
        self.named = tuple(dict.fromkeys(config.default_reviewers))
        self.all_named = bool(config.require_all_reviewers and self.named)
        self.needed = max(config.required_approvals, len(self.named)) if self.all_named else config.required_approvals

    def missing(self, review: Open) -> int:
        return len(self.named) - sum(r in self.named for r in review.approved_by)

    def _out(self, key, status: str, review: Open, at: int, reviewer=None, topic: str | None = None) -> tuple:
        part = TOPIC_PART.get(status)
        return status, review.level, at, reviewer, topic or (f"reviews.{key}.{part}" if part else None), self.missing(review)

    def until(self, key, review: Open | None, now: int, out: list) -> Open | None:
        """Deadlines before ``now``."""
        while review is not None and review.deadline < now:
            at, levels = review.deadline, self.escalation.levels
            if review.level < len(levels):
                level = levels[review.level]
                review = replace(review, level=review.level + 1, deadline=at + int(level.timeout_seconds * 1_000_000))
                out.append(self._out(key, ESCALATED, review, at, None, level.topic))
            else:
                out.append(self._out(key, _LAST[self.escalation.last], review, at, None, self.escalation.last_topic))
                review = None
        return review

    def request(self, key, review: Open | None, at: int, submitter, out: list) -> Open:
        review = self.until(key, review, at, out)
        if review is None:
            review = Open(at + self.config.timeout_seconds * 1_000_000, submitter=submitter)
            out.append(self._out(key, PENDING, review, at))
        return review

    def decision(self, key, review: Open | None, at: int, decision: str, reviewer, out: list) -> Open | None:
        review = self.until(key, review, at, out)
        if review is None:
            out.append((NOT_FOUND, 0, at, reviewer, None, len(self.named)))
            return None
        if decision == APPROVED:
            own = reviewer == review.submitter and not self.config.allow_self_approval
            unnamed = self.all_named and (reviewer not in self.named or reviewer in review.approved_by)
            if own or unnamed:
                out.append(self._out(key, IGNORED, review, at, reviewer))
                return review
            known = reviewer in self.named and reviewer not in review.approved_by
            by = (*review.approved_by, reviewer) if known else review.approved_by
            review = replace(review, approvals=review.approvals + 1, approved_by=by)
        enough = review.approvals >= self.needed
        if enough or decision == REJECTED:
            out.append(self._out(key, APPROVED if enough else REJECTED, review, at, reviewer))
            return None
        return review


def _millis(at_us: int) -> int:
    return at_us // 1000 + 1


def _plain(column: Column, kind: T.DataType) -> Column:
    """Whole numbers as text: pandas would turn a column of them with a NULL into floating numbers."""
    return column.cast("string") if isinstance(kind, T.IntegralType) else column


def _exact(values: pd.Series, kind: T.DataType) -> list:
    return [None if v is None else int(v) for v in values] if isinstance(kind, T.IntegralType) else list(values)


class Reviews(StatefulProcessor):
    """One review: events the watermark has not passed, and the open review with the set of its approvers."""

    def __init__(self, rules: Rules, tie: T.DataType, reviewer: T.DataType, columns: list[str]):
        self.rules, self.reviewer, self.columns = rules, reviewer, columns
        long, text = T.LongType(), T.StringType()
        self.kinds = {"at_us": long, "kind_no": long, "tie": tie, "decision": text, "reviewer": reviewer, "submitter": reviewer}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.coming = handle.getListState("coming", T.StructType([T.StructField(n, t) for n, t in self.kinds.items()]))
        review = [("deadline", T.LongType()), ("level", T.LongType()), ("approvals", T.LongType()), ("submitter", self.reviewer), ("approved_by", T.ArrayType(self.reviewer))]
        self.review = handle.getValueState("review", T.StructType([T.StructField(n, t) for n, t in review]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            given = list(zip(*[_exact(batch[n], kind) for n, kind in self.kinds.items()]))
            self.coming.appendList(given)
            for at in {_millis(int(e[0])) for e in given}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        coming = [tuple(e) for e in self.coming.get()] if self.coming.exists() else []
        now = [e for e in coming if _millis(e[0]) <= due]
        now.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2], e[3] or ""))
        known = self.review.get() if self.review.exists() else None
        review = None if known is None else Open(int(known[0]), int(known[1]), int(known[2]), known[3], tuple(known[4] or ()))
        out: list[tuple] = []
        for at, kind_no, _, decision, reviewer, submitter in now:
            if kind_no == 0:
                review = self.rules.request(key[0], review, int(at), submitter, out)
            else:
                review = self.rules.decision(key[0], review, int(at), decision, reviewer, out)
        # A deadline has passed if its millisecond has.
        while review is not None and _millis(review.deadline) <= due:
            review = self.rules.until(key[0], review, review.deadline + 1, out)
        if now:
            rest = [e for e in coming if _millis(e[0]) > due]
            if rest:
                self.coming.put(rest)
            else:
                self.coming.clear()
        if review is not None:
            self.review.update((review.deadline, review.level, review.approvals, review.submitter, list(review.approved_by)))
            self.handle.registerTimer(_millis(review.deadline))
        elif known is not None:
            self.review.clear()
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.columns)

    def close(self) -> None:
        pass


def reviews(df: DataFrame, config: ReviewConfig, escalation: Escalation = Escalation(), ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Status changes of reviews: review_id, status, level, reviewer, topic, missing, at.

    Columns in: ``review_id``, ``kind`` (``request`` or ``decision``), ``decision``,
    ``reviewer``, ``submitter`` (of a request; of the reviewer's type) and the watermarked
    ``ts``. ``missing`` counts the named reviewers who have not approved. Decisions without
    an open review are ``not_found``, approvals that do not count ``ignored``. Closed reviews leave no state.
    """
    reviewer = df.schema["reviewer"].dataType
    tie_type = T.LongType() if tie is None else df.schema[tie].dataType
    timed = df.select(
        "review_id",
        ts,
        F.unix_micros(ts).alias("at_us"),
        F.when(F.col("kind") == "request", 0).otherwise(1).alias("kind_no"),
        _plain(F.lit(0) if tie is None else F.col(tie), tie_type).alias("tie"),
        "decision",
        _plain(F.col("reviewer"), reviewer).alias("reviewer"),
        _plain(F.col("submitter").cast(reviewer), reviewer).alias("submitter"),
    )
    fields = [("review_id", df.schema["review_id"].dataType), ("status", T.StringType()), ("level", T.LongType()), ("at_us", T.LongType())]
    fields += [("reviewer", reviewer), ("topic", T.StringType()), ("missing", T.LongType())]
    output = T.StructType([T.StructField(n, t) for n, t in fields])
    processor = Reviews(Rules(config, escalation), tie_type, reviewer, output.names)
    changes = timed.groupBy("review_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )
    return changes.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")
