"""Rules by the thousand: an index that finds the best rule of a value without testing them all.

Each rule of a table holds for the values of one interval. The rules of a key are turned
into disjoint segments, each with its best rule: a sweep over the bounds with a heap of
the rules open at that point. A key with many rules is cut into slabs at quantiles of its
bounds, each swept in its own task; a rule that covers whole slabs goes to the few nodes
of a binary tree over the slabs that make up its range, not to each slab. The segments
become a search tree of small nodes, so a row meets a few nodes of bounded size
however many rules its key has.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.operators.decide import DEFAULT_DECISION
from eventflow.operators.ordered import ranked
from eventflow.sources.context import lookup
from eventflow.sources.joins import skew_join
from eventflow.sources.staging import staged

#: Bounds of one slab, which one task sweeps, and the most slabs of a key.
SLAB_BOUNDS = 50_000
MOST_SLABS = 4_096
#: Entries of a node of the search tree.
FANOUT = 64

_KEY, _SLAB = "__key", "__slab"


@dataclass(frozen=True)
class RuleIndex:
    """The search tree by level, leaves first. A leaf's entries have a start and a rule, an inner node's a start and a child."""

    on: tuple[str, ...]
    levels: tuple[DataFrame, ...]
    always: DataFrame
    value_type: T.DataType


def _key(on: list[str]) -> Column:
    """The key as one struct: never NULL, so NULL keys meet too."""
    return F.struct(F.lit(0).alias("_"), *on).alias(_KEY)


def _not_nan(column: Column, kind: T.DataType) -> Column:
    return ~F.isnan(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)


def _intervals(rules: DataFrame, on: list[str], value_type: T.DataType, low: str, high: str, low_closed: bool, high_closed: bool) -> DataFrame:
    """key, start, end (cuts: value and 1 if just after it; NULL if open) and the best rule of each interval."""
    bounds = {"low": F.col(low).cast(value_type), "high": F.col(high).cast(value_type)}
    start = F.when(bounds["low"].isNotNull(), F.struct(bounds["low"].alias("v"), F.lit(0 if low_closed else 1).alias("s")))
    bounded = bounds["high"].isNotNull() & _not_nan(bounds["high"], value_type)
    end = F.when(bounded, F.struct(bounds["high"].alias("v"), F.lit(1 if high_closed else 0).alias("s")))
    best = F.struct((-F.col("priority")).alias("rank"), "ord", "decision")
    rows = rules.where(F.coalesce(_not_nan(bounds["low"], value_type), F.lit(True)))
    rows = rows.select(_key(on), start.alias("start"), end.alias("end"), best.alias("best"))
    rows = rows.where(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < F.col("end")))
    # A rule without priority comes last.
    order = F.struct(F.col("best.rank").isNull(), "best")
    return rows.groupBy(_KEY, "start", "end").agg(F.min_by("best", order).alias("best"))


def _better(column: str) -> Column:
    return F.min_by(column, F.struct(F.col(f"{column}.rank").isNull(), column))


def _slabs(intervals: DataFrame) -> DataFrame:
    """One row per key: its cuts, ascending; none where one task can sweep all its rules."""
    bounds = intervals.select(_KEY, F.explode(F.array("start.v", "end.v")).alias("v")).where("v IS NOT NULL")
    counts = bounds.groupBy(_KEY).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    wanted = min(MOST_SLABS, -(-most // SLAB_BOUNDS))
    keys = intervals.select(_KEY).distinct()
    nothing = F.array().cast(T.ArrayType(bounds.schema["v"].dataType))
    if wanted < 2:
        return keys.withColumn("cuts", nothing)
    fractions = [i / wanted for i in range(1, wanted)]
    cuts = bounds.groupBy(_KEY).agg(
        F.when(F.count("*") > SLAB_BOUNDS, F.array_sort(F.array_distinct(F.percentile_approx("v", fractions, 10 * wanted)))).alias("cuts")
    )
    return keys.join(cuts, _KEY, "left").withColumn("cuts", F.coalesce("cuts", nothing))


def _slab_of(cut: str) -> Column:
    return F.size(F.filter("cuts", lambda c: (c < F.col(f"{cut}.v")) | (c == F.col(f"{cut}.v"))))


def _pieces(intervals: DataFrame, slabs: DataFrame) -> DataFrame:
    """What each slab has to sweep: intervals that begin or end in it, and one for the best rule that covers it whole."""
    placed = skew_join(intervals, slabs, [_KEY])
    first = F.when(F.col("start").isNull(), 0).otherwise(_slab_of("start"))
    last = F.when(F.col("end").isNull(), F.size("cuts")).otherwise(_slab_of("end"))
    placed = staged(placed.select(_KEY, "start", "end", "best", first.alias("a"), last.alias("b"), F.size("cuts").alias("top")), "rule-intervals")

    no_cut = F.lit(None).cast(placed.schema["start"].dataType)
    # The first slab may be covered from its very start, the last up to its very end: those count as covered whole.
    from_start, to_end = F.col("start").isNull(), F.col("end").isNull()
    own = F.array(
        F.when((F.col("a") == F.col("b")), F.struct(F.col("a").alias("slab"), F.col("start"), F.col("end"))),
        F.when((F.col("a") < F.col("b")) & ~from_start, F.struct(F.col("a").alias("slab"), F.col("start"), no_cut.alias("end"))),
        F.when((F.col("a") < F.col("b")) & ~to_end, F.struct(F.col("b").alias("slab"), no_cut.alias("start"), F.col("end"))),
    )
    edges = placed.select(_KEY, F.explode(F.filter(own, lambda p: p.isNotNull())).alias("p"), "best")
    edges = edges.groupBy(_KEY, F.col("p.slab").alias(_SLAB), F.col("p.start").alias("start"), F.col("p.end").alias("end")).agg(_better("best").alias("best"))

    # Slabs low .. high - 1 are covered; at level l of the binary tree that leaves at most one node at each side.
    low, high = F.when(from_start, F.col("a")).otherwise(F.col("a") + 1), F.when(to_end, F.col("b") + 1).otherwise(F.col("b"))
    spans = placed.where(F.col("a") < F.col("b")).select(_KEY, "best", low.cast("long").alias("low"), high.cast("long").alias("high"))
    depth = MOST_SLABS.bit_length()

    def at_level(level: Column) -> Column:
        width = F.pow(F.lit(2), level).cast("long")
        left = F.ceil(F.col("low") / width).cast("long")
        right = F.floor(F.col("high") / width).cast("long")
        node = lambda n: F.struct(level.cast("int").alias("level"), n.alias("node"))
        return F.array(F.when((left < right) & (left % 2 == 1), node(left)), F.when((left < right) & (right % 2 == 1), node(right - 1)))

    nodes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth)), at_level))
    nodes = spans.select(_KEY, "best", F.explode(F.filter(nodes, lambda n: n.isNotNull())).alias("n"))
    nodes = nodes.groupBy(_KEY, F.col("n.level").alias("level"), F.col("n.node").alias("node")).agg(_better("best").alias("cover"))
    all_slabs = slabs.select(_KEY, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias(_SLAB))
    above = all_slabs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    above = above.withColumn("node", F.expr(f"shiftright(CAST({_SLAB} AS BIGINT), level)"))
    covers = skew_join(above, nodes, [_KEY, "level", "node"], "left").groupBy(_KEY, _SLAB).agg(_better("cover").alias("best"))
    return edges.unionByName(covers.select(_KEY, _SLAB, no_cut.alias("start"), no_cut.alias("end"), "best"))


def _place(rank, ord, decision) -> tuple:
    """Sorts rules best first, in Spark's order: a missing priority last, a missing decision first."""
    return rank is None, rank or 0, ord, decision is not None, decision or ""


def sweep(starts: list, ends: list, best: list) -> list[tuple]:
    """Segments (start, rule) in order: the best of the intervals open at each point; the first starts at NULL.

    ``best`` gives each interval's place among the rules, the least being the best (None: no rule).
    """
    points = sorted({p for p in (*starts, *ends) if p is not None})
    at = {p: i + 1 for i, p in enumerate(points)}
    opening: list[list[int]] = [[] for _ in range(len(points) + 1)]
    closes = {}
    for start, end, rule in zip(starts, ends, best):
        if rule is not None:
            opening[0 if start is None else at[start]].append(rule)
            closes[rule] = len(points) + 1 if end is None else at[end]
    heap: list[int] = []
    out: list[tuple] = []
    for cell, opened in enumerate(opening):
        for rule in opened:
            heapq.heappush(heap, rule)
        while heap and closes[heap[0]] <= cell:
            heapq.heappop(heap)
        now = heap[0] if heap else None
        if not out or out[-1][1] != now:
            out.append((points[cell - 1] if cell else None, now))
    return out


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks)


def _segments(pieces: DataFrame) -> DataFrame:
    """The disjoint segments of each slab: key, slab, place, v and s (NULL: from the slab's start), decision."""
    key, cut = pieces.schema[_KEY].dataType, pieces.schema["start"].dataType
    decision = pieces.schema["best"].dataType["decision"].dataType
    fields = [(_KEY, key), (_SLAB, T.IntegerType()), ("place", T.LongType()), ("v", cut["v"].dataType), ("s", T.IntegerType()), ("decision", decision)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(group: pa.Table) -> pa.Table:
        whole = group.select(["start", "end", "best"]).combine_chunks()
        start, end, best = (_one(whole.column(c)) for c in ("start", "end", "best"))
        n_rows = len(best)
        # Cuts are numbered in order, so that the sweep compares numbers.
        cuts = pa.concat_arrays([start, end])
        v, side = (pc.struct_field(cuts, c) for c in ("v", "s"))
        by_cut = pc.sort_indices(pa.table({"v": v, "s": side}), [("v", "ascending"), ("s", "ascending")])
        by_cut = by_cut.filter(pc.is_valid(cuts.take(by_cut)))
        sorted_v, sorted_s = v.take(by_cut), side.take(by_cut)
        new = pc.or_(pc.not_equal(sorted_v[1:], sorted_v[:-1]), pc.not_equal(sorted_s[1:], sorted_s[:-1])).to_numpy(zero_copy_only=False)
        number = np.full(2 * n_rows, -1)
        number[by_cut.to_numpy()] = np.r_[np.zeros(min(len(by_cut), 1), np.int64), np.cumsum(new)]
        at = [None if c < 0 else c for c in number.tolist()]
        firsts = by_cut.to_numpy()[np.r_[np.ones(min(len(by_cut), 1), bool), new.astype(bool)]]
        # Within a slab each row is a rule of its own, numbered from the best on.
        ranks, ords, decisions = (pc.struct_field(best, c).to_pylist() for c in ("rank", "ord", "decision"))
        order = sorted(np.flatnonzero(pc.is_valid(best).to_numpy(zero_copy_only=False)).tolist(), key=lambda i: _place(ranks[i], ords[i], decisions[i]))
        place = {i: n for n, i in enumerate(order)}
        found = sweep(at[:n_rows], at[n_rows:], [place.get(i) for i in range(n_rows)])
        n = len(found)
        decided = [None if rule is None else decisions[order[rule]] for _, rule in found]
        starts = pa.array([None if p is None else int(firsts[p]) for p, _ in found], pa.int64())
        same = lambda c: pa.chunked_array([_one(group[c]).take(pa.array([0] * n, pa.int64()))])
        cut_type = group.schema.field("start").type
        return pa.table(
            {
                _KEY: same(_KEY),
                _SLAB: same(_SLAB),
                "place": pa.array(range(n), pa.int64()),
                "v": v.take(starts).cast(cut_type.field("v").type),
                "s": side.take(starts).cast(pa.int32()),
                "decision": pa.array(decided, group.schema.field("best").type.field("decision").type),
            }
        )

    return pieces.groupBy(_KEY, _SLAB).applyInArrow(run, schema)


def build(
    rules: DataFrame,
    on: list[str],
    value_type: str,
    low: str = "low",
    high: str = "high",
    low_closed: bool = True,
    high_closed: bool = False,
) -> RuleIndex:
    """An index of rules with columns ``priority, ord, decision``, the key columns ``on``, and bounds.

    A rule holds for values from ``low`` to ``high`` (NULL: open) of its key; ``low_closed``
    and ``high_closed`` tell whether the bounds belong to it. Higher priorities win, then
    the smaller ``ord``, then the smaller decision. Bounds are numbers, dates or times of
    ``value_type``. Rules whose interval is empty never hold. The index is written to the shared folder.
    """
    kind = rules.select(F.lit(None).cast(value_type)).schema[0].dataType
    intervals = staged(_intervals(rules, on, kind, low, high, low_closed, high_closed), "rules")
    slabs = staged(_slabs(intervals), "rule-slabs")
    segments = staged(_segments(_pieces(intervals, slabs)), "rule-segments")
    cuts = slabs.select(_KEY, F.posexplode("cuts").alias(_SLAB, "from")).withColumn(_SLAB, F.col(_SLAB) + 1)
    starts = segments.join(cuts, [_KEY, _SLAB], "left").select(
        _KEY,
        _SLAB,
        "place",
        # A slab's first segment starts with the slab; the very first one is open.
        F.when(F.col("s").isNull(), F.col("from")).otherwise(F.col("v")).alias("v"),
        F.when(F.col("s").isNull() & F.col("from").isNotNull(), 0).otherwise(F.col("s")).alias("s"),
        "decision",
    )
    entries = ranked(starts, [_KEY], [F.col(_SLAB), F.col("place")], F.col(_SLAB), "n").withColumn("at", F.col("n") - 1)
    entries = entries.select(_KEY, "at", "v", "s", "decision")
    levels = []
    while True:
        node = entries.withColumn("node", F.floor(F.col("at") / FANOUT))
        given = [c for c in entries.columns if c != _KEY]
        level = node.groupBy(_KEY, "node").agg(F.sort_array(F.collect_list(F.struct(*given))).alias("entries"))
        levels.append(staged(level, f"rule-level-{len(levels)}"))
        if not (levels[-1].agg(F.max("node")).first()[0] or 0):
            break
        first = F.col("entries")[0]
        entries = levels[-1].select(_KEY, F.col("node").alias("at"), first["v"].alias("v"), first["s"].alias("s"))
    always = intervals.where("start IS NULL AND end IS NULL").select(_KEY, F.col("best.decision").alias("always"))
    return RuleIndex(tuple(on), tuple(levels), staged(always, "rules-always"), kind)


def _last_reached(entries: str, x: Column) -> Column:
    """Place of the last entry that starts at or before ``x`` (-1: none), found by halving: a few entries are looked at, not all."""

    def reached(at: Column) -> Column:
        e = F.get(entries, at)
        return e.isNotNull() & (e["s"].isNull() | (e["v"] < x) | ((e["v"] == x) & (e["s"] == 0)))

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(FANOUT.bit_length()))])
    return F.aggregate(steps, F.lit(-1), lambda at, step: F.when(reached(at + step), at + step).otherwise(at))


def decide(df: DataFrame, index: RuleIndex, value: str, default: str = DEFAULT_DECISION, into: str = "decision") -> DataFrame:
    """Add the decision of the best rule of the row's key whose interval holds the value.

    A NULL value is in no interval: only rules open at both ends hold for it. One join with nodes
    of at most ``FANOUT`` entries for each level of the tree; a stream can be decided the same way.
    """
    asked = df.withColumns({_KEY: _key(list(index.on)), "__x": F.col(value).cast(index.value_type), "__node": F.lit(0).cast("long")})
    found = asked
    for depth in reversed(range(len(index.levels))):
        nodes = index.levels[depth].select(_KEY, F.col("node").alias("__node"), F.col("entries").alias("__entries"))
        found = lookup(found, nodes, [_KEY, "__node"])
        last = F.get("__entries", _last_reached("__entries", F.col("__x")))
        if depth:
            found = found.withColumn("__node", last["at"]).drop("__entries")
        else:
            found = found.withColumn("__found", last["decision"]).drop("__entries")
    found = lookup(found, index.always, [_KEY])
    chosen = F.when(F.col("__x").isNull(), F.col("always")).otherwise(F.col("__found"))
    kept = [c for c in df.columns if c != into]
    return found.select(*kept, F.coalesce(chosen, F.lit(default)).alias(into))
