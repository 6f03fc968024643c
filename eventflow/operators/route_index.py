"""Routes by the thousand, from a table: an index of the texts their patterns need.

Most patterns can be found only where a certain plain text stands. These texts go into
one automaton that reads a payload once, whatever their number; only the patterns
whose text occurs are then searched, and those that need no text. A row stays one row and nothing is shuffled.

A table too large for that (``stored``) stays a table: the pieces of a payload that may be such a
text are joined to the routes by their hash, and of equal payloads one is searched.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.functions.patterns import needed_texts, valid_patterns
from eventflow.sources.joins import skew_join
from eventflow.sources.staging import staged

#: Routes and characters of patterns a table may hold; all of them are sent to every task.
MOST_ROUTES = 100_000
MOST_CHARS = 16 << 20
#: Stored routes: bits of the filter that tells which pieces of a payload may be texts, and characters hashed at once.
MARK_BITS = 24
CHARS = 1 << 20
#: Longer texts are looked up by their first characters, as many as the greatest power of two they have.
WHOLE_CHARS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAYLOAD, _MARK = "__payload", "__mark"
_FOUND = "array<struct<route_id:string,target:string>>"


@dataclass(frozen=True)
class RouteTable:
    """Usable routes, best first, and the numbers of those that need a text."""

    ids: list[str]
    patterns: list[str]
    targets: list[str | None]
    by_text: dict[str, list[int]]
    always: list[int]


@dataclass(frozen=True)
class StoredRoutes:
    """Usable routes of any number in the shared folder; ``n`` grows from the best on."""

    by_text: DataFrame
    always: DataFrame | None
    lengths: tuple[int, ...]
    filled: bytes


def _best_first() -> list[Column]:
    return [F.col("priority").desc_nulls_last(), F.col("ord").asc_nulls_last(), F.col("route_id").asc_nulls_last()]


def load(routes: DataFrame) -> RouteTable:
    """Routes from a table with columns ``route_id, pattern, target, priority, ord``.

    The greatest ``priority`` is best, then the smallest ``ord``; NULLs come last. An invalid or NULL pattern never
    matches. Repeated rows are routes of their own. A table beyond ``MOST_ROUTES`` or ``MOST_CHARS`` is refused: see ``stored``.
    """
    size = routes.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).head()
    if size[0] > MOST_ROUTES or size[1] > MOST_CHARS:
        raise ValueError(f"{size[0]} routes with {size[1]} characters; at most {MOST_ROUTES} with {MOST_CHARS}")
    rows = routes.orderBy(*_best_first()).select(F.col("route_id").cast("string"), "pattern", "target").collect()
    rows = [r for r, valid in zip(rows, valid_patterns(routes.sparkSession, [r.pattern for r in rows])) if valid]
    by_text: dict[str, list[int]] = {}
    always = []
    for n, row in enumerate(rows):
        texts = needed_texts(row.pattern)
        if texts is None:
            always.append(n)
        for text in texts or ():
            by_text.setdefault(text, []).append(n)
    return RouteTable([r.route_id for r in rows], [r.pattern for r in rows], [r.target for r in rows], by_text, always)


def _looked_up(length: int) -> int:
    """Characters of a text that its mark covers."""
    return length if length <= WHOLE_CHARS else 1 << (length.bit_length() - 1)


def _marks(texts: list[str], lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, mark) of every piece of each of the ``lengths``, one length after the other.

    A mark is a polynomial over the characters modulo 2**64, with its bits mixed.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    counts = np.array([len(t) for t in texts], np.int64)
    owner, rest = np.repeat(np.arange(len(texts)), counts), np.repeat(np.cumsum(counts), counts) - np.arange(len(codes))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(len(codes) - 1, 0), _BASE)])[: len(codes)]
        back = np.cumprod(np.r_[np.uint64(1), np.full(max(len(codes) - 1, 0), np.uint64(pow(int(_BASE), -1, 1 << 64)))])[: len(codes)]
        sums = np.r_[np.uint64(0), np.cumsum(codes * powers)]
        for length in lengths:
            at = np.flatnonzero(rest >= length)
            mark = (sums[at + length] - sums[at]) * back[at]
            mark = (mark ^ (mark >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            yield owner[at], mark ^ (mark >> np.uint64(32))


def _in_portions(texts: pd.Series) -> Iterator[list[str]]:
    """The texts, NULL as empty, in portions of ``CHARS`` characters or of one text."""
    portion, held = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if portion and held + len(text) > CHARS:
            yield portion
            portion, held = [], 0
        portion.append(text)
        held += len(text)
    if portion:
        yield portion


def _mark_of(text: Column) -> Column:
    """Mark of a text's looked-up characters, and how many these are."""

    @F.pandas_udf("mark long, length int")
    def of(texts: pd.Series) -> pd.DataFrame:
        heads = [t[: _looked_up(len(t))] for t in texts]
        lengths, marks = np.array([len(h) for h in heads], np.int32), np.zeros(len(heads), np.uint64)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            marks[own] = next(_marks([heads[i] for i in own], [length]))[1]
        return pd.DataFrame({"mark": marks.view(np.int64), "length": lengths})

    return of(text)


def _occurring(payload: Column, lengths: tuple[int, ...], filled: bytes) -> Column:
    """Marks of the payload's pieces that may be texts of routes."""

    @F.pandas_udf("array<long>")
    def occurring(payloads: pd.Series) -> pd.Series:
        bits, out = np.frombuffer(filled, np.uint8), []
        for texts in _in_portions(payloads):
            owners, marks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for owner, mark in _marks(texts, list(lengths)):
                slot = (mark >> np.uint64(64 - MARK_BITS)).astype(np.int64)
                some = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                owners.append(owner[some])
                marks.append(mark[some])
            owner, mark = np.concatenate(owners), np.concatenate(marks)
            order = np.lexsort((mark, owner))
            owner, mark = owner[order], mark[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])][: len(owner)]
            owner, mark = owner[new], mark[new].view(np.int64)
            out += np.split(mark, np.searchsorted(owner, np.arange(1, len(texts))))
        return pd.Series(out, dtype=object)

    return occurring(payload)


def stored(routes: DataFrame) -> StoredRoutes:
    """Routes from a table as ``load`` takes it, of any size: nothing but a filter of fixed size goes through the driver.

    Patterns are checked and their texts taken inside the tasks. The routes are written to the shared folder.
    """

    @F.pandas_udf("array<string>")
    def texts(patterns: pd.Series) -> pd.Series:
        return pd.Series([needed_texts(p) for p in patterns], dtype=object)

    valid = routes.where(F.expr("try_reflect('java.util.regex.Pattern', 'compile', CAST(pattern AS STRING))").isNotNull())
    ordered = valid.orderBy(*_best_first()).select(F.col("route_id").cast("string"), F.col("pattern").cast("string"), "target")
    # Ids grow along the sorted partitions.
    rows = staged(ordered.withColumn("n", F.monotonically_increasing_id()), "routes")
    rows = staged(rows.withColumn("texts", texts("pattern")), "route-texts")
    by_text = rows.select("n", "route_id", "pattern", "target", F.explode(F.array_distinct("texts")).alias("text"))
    by_text = by_text.withColumn("m", _mark_of("text")).withColumn(_MARK, F.col("m.mark")).withColumn("length", F.col("m.length")).drop("m")
    by_text = staged(by_text, "routes-by-text")
    slot = F.shiftrightunsigned(_MARK, 64 - MARK_BITS)
    bits = by_text.select(slot.alias("slot")).selectExpr("CAST(slot >> 3 AS INT) AS at", "shiftleft(1, CAST(slot & 7 AS INT)) AS bit")
    bits = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    filled = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    some = bits.toPandas()
    filled[some["at"]] = some["bits"]
    always = rows.where("texts IS NULL").drop("texts")
    lengths = sorted(r.length for r in by_text.select("length").distinct().collect())
    return StoredRoutes(by_text, None if always.isEmpty() else always, tuple(lengths), filled.tobytes())


def _candidates(payload: Column, table: RouteTable) -> Column:
    """Numbers of the routes whose text occurs and of those without one, ascending."""
    by_text, always = table.by_text, table.always

    @F.pandas_udf("array<int>")
    def occurring(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for text, numbers in by_text.items():
            tree.add_word(text, numbers)
        tree.make_automaton()
        for payloads in batches:
            found = []
            for text in payloads:
                hits = set(always)
                if by_text and isinstance(text, str):
                    for _, numbers in tree.iter(text):
                        hits.update(numbers)
                found.append(sorted(hits))
            yield pd.Series(found, dtype=object)

    return occurring(payload)


def _constant(values: list) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _matching_stored(df: DataFrame, table: StoredRoutes, payload: str, into: str) -> DataFrame:
    """Pairs of a payload and a route whose text may occur are searched one by one; the hits of a payload are gathered."""
    text = F.col(_PAYLOAD)
    payloads = df.select(F.col(payload).cast("string").alias(_PAYLOAD)).where(text.isNotNull()).distinct()
    route = [_PAYLOAD, "n", "route_id", "target"]
    pieces = payloads.select(_PAYLOAD, F.explode(_occurring(text, table.lengths, table.filled)).alias(_MARK))
    hits = skew_join(pieces, table.by_text, [_MARK]).where(F.contains(text, F.col("text")) & F.rlike(text, F.col("pattern"))).select(*route)
    if table.always is not None:
        hits = hits.unionByName(payloads.join(table.always, F.rlike(text, F.col("pattern"))).select(*route))
    # A route found by several of its texts is one.
    found = hits.groupBy(_PAYLOAD).agg(F.sort_array(F.collect_set(F.struct("n", "route_id", "target"))).alias("__hits"))
    found = found.select(_PAYLOAD, F.transform("__hits", lambda h: F.struct(h["route_id"], h["target"])).cast(_FOUND).alias(into))
    kept = [c for c in df.columns if c != into]
    joined = skew_join(df.select(*kept).withColumn(_PAYLOAD, F.col(payload).cast("string")), found, [_PAYLOAD], "left")
    return joined.select(*kept, F.coalesce(into, F.array().cast(_FOUND)).alias(into))


def matching(df: DataFrame, table: RouteTable | StoredRoutes, payload: str = "payload", into: str = "routes") -> DataFrame:
    """Add ``into``: ``{route_id, target}`` of all routes whose pattern is found in the payload, best first.

    A NULL payload matches none. The first entry is the route of first-match routing, all are those of multicast.
    Routes that were ``stored`` take two shuffles of the payloads; the rows stay as many.
    """
    if isinstance(table, StoredRoutes):
        return _matching_stored(df, table, payload, into)
    patterns, ids, targets = _constant(table.patterns), _constant(table.ids), _constant(table.targets)
    found = F.filter(_candidates(F.col(payload), table), lambda n: F.coalesce(F.rlike(F.col(payload), F.get(patterns, n)), F.lit(False)))
    return df.withColumn(into, F.transform(found, lambda n: F.struct(F.get(ids, n).alias("route_id"), F.get(targets, n).alias("target"))))
