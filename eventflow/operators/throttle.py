"""At most one message per key and time-to-live.

The first message of a key passes; later ones are held back until more than
``ttl`` has gone by since the last one that passed. Whether a message passes
depends on all earlier ones, so a hot key cannot simply be cut. It is still
computed in time chunks side by side:

1. per (key, chunk): for each message, which one would be the last to pass in
   this chunk if this message passed. That map never decreases, so only its
   steps are kept, usually a handful.
2. per key: walk the chunks over these steps to learn the last passing time
   before each chunk.
3. per (key, chunk): replay with that starting point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = np.iinfo(np.int64).min


class _Runs:
    """Ascending times in consecutive groups, searched for all groups at once.

    Times are replaced by their rank and laid out on one axis, each group in a
    lane of its own, so a single binary search over the axis serves every row.
    """

    def __init__(self, at: np.ndarray, group: np.ndarray):
        opens = np.append(True, group[1:] != group[:-1])
        self.at, self.start = at, np.flatnonzero(opens)
        self.end = np.append(self.start[1:], len(at))
        self.of = np.cumsum(opens) - 1
        self.times = np.unique(at)
        self.lane = len(self.times) + 1
        self.axis = np.searchsorted(self.times, at) + self.of * self.lane

    def first_after(self, when: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Index of the first row of ``group`` later than ``when``; the group's end if none is."""
        rank = np.searchsorted(self.times, when, side="right")
        return np.searchsorted(self.axis, rank + group * self.lane)

    def following(self, ttl: int) -> np.ndarray:
        """For each row, the next one that passes if this one does."""
        return self.first_after(self.at + ttl, self.of)


def _last_passing(runs: _Runs, ttl: int) -> np.ndarray:
    """For each row, the last passing time of its group if the chain starts there."""
    ahead, rows = runs.following(ttl), np.arange(len(runs.at))
    jump = np.where(ahead < runs.end[runs.of], ahead, rows)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return runs.at[jump]
        jump = further


def _summarise(pdf: pd.DataFrame, ttl: int) -> dict:
    """The steps of that map: the latest start of each, and where it ends up."""
    runs = _Runs(pdf["at"].to_numpy(), pdf["g"].to_numpy())
    last = _last_passing(runs, ttl)
    ends = np.append((last[1:] != last[:-1]) | (runs.of[1:] != runs.of[:-1]), True)
    return {"g": pdf["g"].to_numpy()[ends], "until": runs.at[ends], "last": last[ends]}


def _walk(pdf: pd.DataFrame, ttl: int, key: str | None, carry: int) -> tuple[dict, str, int]:
    """The last passing time before each chunk (rows: steps by key, chunk, start).

    ``key`` and ``carry`` are the state the batch before ended with.
    """
    keys, labels, last = (pdf[c].to_numpy() for c in ("k", "g", "last"))
    runs = _Runs(pdf["until"].to_numpy(), labels)
    key_of = (np.cumsum(np.append(True, keys[1:] != keys[:-1])) - 1)[runs.start]
    state = np.full(key_of[-1] + 1, _NONE)
    state[0] = carry if keys[0] == key else _NONE
    before = np.empty(len(runs.start), np.int64)
    # All keys advance side by side: first the first chunk of each, then the second.
    turn = np.arange(len(key_of)) - np.searchsorted(key_of, key_of)
    for part in np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1]):
        before[part] = known = state[key_of[part]]
        fresh = known == _NONE
        hit = np.where(fresh, runs.start[part], runs.first_after(np.where(fresh, 0, known) + ttl, part))
        found = hit < runs.end[part]
        state[key_of[part][found]] = last[hit[found]]
    return {"g": labels[runs.start], "carry": before}, keys[-1], int(state[-1])


def _replay(pdf: pd.DataFrame, ttl: int, label: str | None, carry: int) -> tuple[dict, str, int]:
    """The rows that pass, starting from each group's ``carry``, or for a group that
    goes on from the batch before, from the last one that passed there."""
    labels = pdf["g"].to_numpy()
    runs = _Runs(pdf["at"].to_numpy(), labels)
    known, groups = pdf["carry"].to_numpy()[runs.start].copy(), np.arange(len(runs.start))
    if labels[0] == label:
        known[0] = carry
    fresh = known == _NONE
    entry = np.where(fresh, runs.start, runs.first_after(np.where(fresh, 0, known) + ttl, groups))
    ahead, keep = runs.following(ttl), np.zeros(len(runs.at), dtype=bool)
    front = entry[entry < runs.end]
    while len(front):
        keep[front] = True
        after = ahead[front]
        front = after[after < runs.end[runs.of[front]]]
    passed = np.flatnonzero(keep[runs.start[-1] :])
    final = runs.at[runs.start[-1] + passed[-1]] if len(passed) else known[-1]
    return {"g": labels[keep], "at": runs.at[keep]}, labels[-1], int(final)


def _whole_groups(batches: Iterator[pd.DataFrame], group: str) -> Iterator[pd.DataFrame]:
    """Batches cut so that no group is spread over two of them; rows come sorted by group."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        codes = pdf[group].to_numpy()
        if held and held[-1][group].iloc[-1] != codes[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        tail = int(np.flatnonzero(codes == codes[-1])[0])
        if tail > 0:
            yield pd.concat([*held, pdf.iloc[:tail]], ignore_index=True)
            held = []
        held.append(pdf.iloc[tail:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _summaries(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    for pdf in _whole_groups(batches, "g"):
        yield pd.DataFrame(_summarise(pdf, ttl))


def _carries(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    key, carry = None, _NONE
    for pdf in _whole_groups(batches, "g"):
        rows, key, carry = _walk(pdf, ttl, key, carry)
        yield pd.DataFrame(rows)


def _replays(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    label, carry = None, _NONE
    for pdf in batches:
        if not pdf.empty:
            rows, label, carry = _replay(pdf, ttl, label, carry)
            yield pd.DataFrame(rows)


def _in_order(df: DataFrame, by: str, order: list[str], step: Callable, ttl: int, schema: str) -> DataFrame:
    """Run ``step`` over the rows of each ``by``, sorted; many small groups share a batch."""
    sorted_rows = df.repartition(by).sortWithinPartitions(by, *order)
    return sorted_rows.mapInPandas(lambda batches: step(batches, ttl), schema)


def throttle(df: DataFrame, key: str, ts: str, chunk: Column, ttl_seconds: float | None, tie: str) -> DataFrame:
    """The messages that pass. ``ttl_seconds=None`` keeps a key's first message only.

    Of messages with the same key and time the one with the smallest ``tie``
    is considered. ``chunk`` is a time column that never decreases with ``ts``;
    the result is the same for any, but it should span several times the ttl,
    so that summaries are short, and hold what fits a task's memory of one key.
    """
    if ttl_seconds is None:
        return _first_only(df, key, ts, tie)
    ttl = int(ttl_seconds * 1_000_000)
    digest = F.md5(F.to_json(F.struct(key)))
    label = F.concat_ws("/", digest, F.unix_micros(chunk.cast("timestamp")).cast("string"))
    marked = df.withColumns({"g": label, "at": F.unix_micros(F.col(ts).cast("timestamp"))})
    times = marked.select("g", "at").distinct()

    steps = _in_order(times, "g", ["at"], _summaries, ttl, "g string, until bigint, last bigint")
    parts = F.split("g", "/")
    by_key = steps.select(parts[0].alias("k"), parts[1].cast("bigint").alias("c"), "g", "until", "last")
    carries = _in_order(by_key, "k", ["c", "until"], _carries, ttl, "g string, carry bigint")
    passed = _in_order(times.join(carries, on="g"), "g", ["at"], _replays, ttl, "g string, at bigint")
    return _one_per_instant(marked.join(passed, on=["g", "at"]), ["g", "at"], tie).select(*df.columns)


def _one_per_instant(df: DataFrame, by: list[str], tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min_by(F.struct(*rest), tie).alias("__row"))
    return best.select(*by, "__row.*")


def _first_only(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(ts, tie)).alias("__row"))
    return best.select(key, "__row.*").select(*df.columns)
