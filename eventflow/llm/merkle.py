"""A Merkle manifest of a table, kept as logs of nodes in the order of their completion (postorder).

Rows are leaves. The leaves of a group, in the order of their ids, form a tree: every
``FANOUT`` consecutive nodes become their parent until one is left, the group's subroot;
the subroots, in the order of the groups, form the tree of the root. A builder takes an
aligned block of ``FANOUT ** DEPTH`` leaves and appends each node as soon as its last
child is there; the blocks' tops are the leaves of the next tier, so one task never sees
more than a block. Where a node stands in the log follows from the sizes of the subtrees
before it (``position``), so a proof addresses siblings without searching.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import written

FANOUT = 8
#: Levels that a builder adds to its leaves: a block has at most 4096 leaves and 4681 nodes.
DEPTH = 4
BLOCK = FANOUT**DEPTH
#: Key of the one tree over all subroots.
WHOLE = ""


def field(value: Column) -> Column:
    """A value so written that neighbours cannot run together: ``-`` for null, else bytes, colon, text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(values: list[Column]) -> Column:
    """SHA-256 of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def leaves(docs: DataFrame, columns: list[str], id_col: str, group_col: str, claim: Column | None = None) -> DataFrame:
    """One leaf per row: id, grp, digest, claim, row, written once.

    ``claim`` is the digest of the row as it is found when it is audited, null where that
    is the leaf itself. The group's key puts null first and keeps texts in bytewise order.
    """
    picked = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
        digest_of([F.col(c) for c in columns]).alias("digest"),
        (F.lit(None) if claim is None else claim).cast("binary").alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(picked, "merkle-leaves")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index``, their place in the group by id (null first), digest and row, and ``n``, the group's rows.

    One range shuffle sorts all rows; each partition counts on its own, and only the
    counts by partition and group meet. Repeats of one row differ in ``row``, so they spread.
    """
    key = ["grp", "id", "digest", "row"]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + ", part int, place long"

    def count(batches):
        part, group, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("grp").dictionary_encode()
            starts = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1))
            place = np.arange(batch.num_rows) - np.repeat(starts, np.diff(starts, append=batch.num_rows))
            last = batch.column("grp")[batch.num_rows - 1].as_py()
            if batch.column("grp")[0].as_py() == group:
                place[: starts[1] if len(starts) > 1 else batch.num_rows] += seen
            group, seen = last, int(place[-1]) + 1
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "place"])

    placed = written(ordered.mapInArrow(count, schema), "merkle-order")
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("rows"))
    # A group has at most one row for each partition here.
    spans = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("part", "rows"))).alias("parts"), F.sum("rows").alias("n"))
    first = F.expr("aggregate(slice(parts, 1, i), 0L, (s, p) -> s + p.rows)").alias("first")
    spans = spans.select("grp", "n", "parts", F.posexplode("parts").alias("i", "p")).select("grp", "n", F.col("p.part").alias("part"), first)
    return placed.join(spans, ["grp", "part"]).withColumn("index", F.col("first") + F.col("place")).drop("part", "place", "first")


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def position(level, index, n: int, top: int):
    """Where the log of a tree of ``n`` leaves and levels up to ``top`` has the node ``index`` of ``level``, from 0.

    Before a node come all nodes below it or to its left: of its own level and lower ones
    those that end with its last leaf or earlier, of higher ones those complete before its first leaf.
    """
    level, index = np.asarray(level, np.int64), np.asarray(index, np.int64)
    first = index * FANOUT**level
    end = np.minimum(first + FANOUT**level, n)
    at = np.full(np.broadcast(level, index).shape, -1, np.int64)
    for other in range(top + 1):
        width = FANOUT**other
        at += np.where(other <= level, -(-end // width), first // width)
    return at


def parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def append_nodes(digests: list[str], top: int) -> list[tuple[int, str]]:
    """The log of one block: (level, digest) of every node in the order of completion; its last node is of level ``top``."""
    log: list[tuple[int, str]] = []
    unfinished: list[list[str]] = [[] for _ in range(top + 1)]

    def add(level: int, digest: str) -> None:
        log.append((level, digest))
        run = unfinished[level]
        run.append(digest)
        if len(run) == FANOUT and level < top:
            close(level)

    def close(level: int) -> None:
        run, unfinished[level] = unfinished[level], []
        add(level + 1, parent(run))

    for digest in digests:
        add(0, digest)
    for level in range(top):
        if unfinished[level]:
            close(level)
    return log


def _top(n: int) -> int:
    """Levels that a block adds in a tier of ``n`` nodes."""
    return DEPTH if n > BLOCK else height(n)


def _built(nodes: DataFrame, tier: int) -> DataFrame:
    """A tier's log: a row per node with its block, level and place in the block, and its position in the tree's log."""
    id_type = nodes.schema["id"].dataType.simpleString()
    schema = f"grp string, block long, n long, total long, level int, place int, position long, digest binary, id {id_type}, claim binary"

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("index")
        count, n, total = group.num_rows, group["n"][0].as_py(), group["total"][0].as_py()
        block = group["block"][0].as_py()
        log = append_nodes([d.hex() for d in group["digest"].to_pylist()], _top(n))
        level = np.array([node[0] for node in log], np.int32)
        place = np.zeros(len(log), np.int32)
        for each in range(level.max() + 1):
            of_level = level == each
            place[of_level] = np.arange(of_level.sum())
        whole_index = block * FANOUT ** (DEPTH - level.astype(np.int64)) + place
        leaf = pa.array(np.where(level == 0, place, count))
        padded = [pa.concat_arrays([*group[c].chunks, pa.nulls(1, group[c].type)]).take(leaf) for c in ("id", "claim")]
        same = lambda value: pa.array(np.full(len(log), value, np.int64))
        return pa.table(
            {
                "grp": pa.array([group["grp"][0].as_py()] * len(log)),
                "block": same(block),
                "n": same(n),
                "total": same(total),
                "level": level,
                "place": place,
                "position": position(level + DEPTH * tier, whole_index, total, height(total)),
                "digest": pa.array([bytes.fromhex(node[1]) for node in log], pa.binary()),
                "id": padded[0],
                "claim": padded[1],
            }
        )

    blocks = nodes.withColumn("block", F.expr(f"index div {BLOCK}")).groupBy("grp", "block")
    return written(blocks.applyInArrow(build, schema), "merkle-log")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The logs of all trees, from the leaves up; a further tier while some tree has more than one block."""
    nodes = nodes.withColumn("total", F.col("n"))
    tiers = []
    while True:
        tiers.append(_built(nodes, len(tiers)))
        tops = tiers[-1].where((F.col("n") > BLOCK) & (F.col("level") == DEPTH))
        if tops.isEmpty():
            return tiers
        n = F.ceil(F.col("n") / BLOCK).cast("long").alias("n")
        nodes = tops.select("id", "grp", "digest", "claim", F.col("block").alias("index"), n, "total")


def _summits(tiers: list[DataFrame]) -> DataFrame:
    """The last node of each tree: grp, digest."""
    found = None
    for log in tiers:
        last = log.where(F.col("n") <= BLOCK).groupBy("grp").agg(F.max_by("digest", "position").alias("digest"))
        found = last if found is None else found.unionByName(last)
    return found


@dataclass
class Manifest:
    """The logs of the groups' trees and of the tree over their subroots, by tier."""

    groups: list[DataFrame]
    whole: list[DataFrame]

    def log(self) -> DataFrame:
        """Every node once: grp (null: the tree of subroots), position, level, digest, id (of leaves)."""
        parts = []
        for tiers, name in ((self.groups, F.col("grp")), (self.whole, F.lit(None).cast("string"))):
            for tier, rows in enumerate(tiers):
                own = rows if tier == 0 else rows.where("level > 0")
                own_id = F.col("id") if tiers is self.groups else F.lit(None).cast(self.groups[0].schema["id"].dataType)
                parts.append(own.select(name.alias("grp"), "position", (F.col("level") + DEPTH * tier).alias("level"), "digest", own_id.alias("id")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def build(leaf_rows: DataFrame) -> Manifest:
    """The manifest of a table of ``leaves``."""
    groups = _tiers(numbered(leaf_rows))
    subroots = written(_summits(groups), "merkle-subroots")
    row, claim = F.lit(0).cast("long").alias("row"), F.lit(None).cast("binary").alias("claim")
    whole = _tiers(numbered(subroots.select(F.col("grp").alias("id"), F.lit(WHOLE).alias("grp"), "digest", claim, row)))
    return Manifest(groups, whole)


SIDES = "array<struct<before: string, after: string>>"


def _extracted(log: DataFrame, paths: DataFrame | None, last: bool) -> DataFrame:
    """Walks from each leaf of a tier to the root: siblings, and for the last tier proof and folded root.

    ``paths`` has (grp, block, sides, subroot, root), the way on from each block's top; it
    travels as one row of the block. Siblings are read at their closed-form positions in the block's log.
    """
    id_type = log.schema["id"].dataType.simpleString()
    more = {"sides": SIDES, "subroot": "binary", "root": "binary"}
    rows = log.select(*log.columns, *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
    if paths is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema if f.name not in ("grp", "block")]
        rows = rows.unionByName(paths.select("grp", "block", *blank, *more))

    def extract(group: pa.Table) -> pa.Table:
        is_path = group["level"].is_null()
        path = group.filter(is_path)
        nodes = group.filter(group["level"].is_valid()).sort_by("position")
        log = [d.hex() for d in nodes["digest"].to_pylist()]
        level = nodes["level"].to_numpy()
        count, top = int((level == 0).sum()), int(level.max())
        above = [(s["before"], s["after"]) for s in path["sides"][0].as_py()] if path.num_rows else []
        around = []
        for each in range(top):
            width = -(-count // FANOUT**each)
            row = [log[p] for p in position(each, np.arange(width), count, top)]
            runs = [row[i : i + FANOUT] for i in range(0, width, FANOUT)]
            around.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        sides = [[around[each][i // FANOUT**each] for each in range(top)] + above for i in range(count)]
        at = position(0, np.arange(count), count, top)
        leaf_rows = nodes.take(pa.array(at))
        tops = [path[c][0].as_py() if path.num_rows else None for c in ("subroot", "root")]
        summit = bytes.fromhex(log[-1])
        subroot, root = tops[0] or summit, tops[1] or summit
        if not last:
            shaped = [[{"before": a, "after": b} for a, b in walk] for walk in sides]
            return pa.table(
                {
                    "id": leaf_rows["id"],
                    "grp": leaf_rows["grp"],
                    "block": pa.array(leaf_rows["block"].to_numpy() * BLOCK + np.arange(count)),
                    "sides": pa.array(shaped, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                    "subroot": pa.array([subroot] * count, pa.binary()),
                    "root": pa.array([root] * count, pa.binary()),
                }
            )
        claims, proofs, folded = leaf_rows["claim"].to_pylist(), [], []
        for i, walk in enumerate(sides):
            proofs.append(hashlib.sha256("".join([a + b for a, b in walk]).encode()).hexdigest())
            digest = claims[i].hex() if claims[i] is not None else log[at[i]]
            for a, b in walk:
                digest = hashlib.sha256((a + digest + b).encode()).hexdigest()
            folded.append(digest)
        return pa.table(
            {
                "id": leaf_rows["id"],
                "leaf": pa.array([log[p] for p in at]),
                "subroot": pa.array([subroot.hex()] * count),
                "root": pa.array([root.hex()] * count),
                "proof_sha256": proofs,
                "folded_root": folded,
            }
        )

    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    if not last:
        schema = f"id {id_type}, grp string, block long, sides {SIDES}, subroot binary, root binary"
    return rows.groupBy("grp", "block").applyInArrow(extract, schema)


def audit(manifest: Manifest) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the leaf's siblings, level by level to the root, left
    to right; ``folded_root`` the root computed from the claim (else the leaf) and these
    siblings. Null ids come first in their group, repeated rows are leaves like any other,
    an empty table has an empty result.
    """
    paths = None
    for log in reversed(manifest.whole):
        paths = written(_extracted(log, paths, last=False), "merkle-paths")
    # The way on from a tree's top is that of its subroot, which the tree of subroots knows by the group.
    subroot = _summits(manifest.groups).withColumnRenamed("digest", "subroot")
    tree_paths = paths.select(F.col("id").alias("grp"), "sides", "root").join(subroot, "grp")
    tree_paths = written(tree_paths, "merkle-paths")
    found = None
    for tier in reversed(range(len(manifest.groups))):
        log = manifest.groups[tier]
        ends = log.where((F.col("n") <= BLOCK) & (F.col("level") == 0) & (F.col("place") == 0)).select("grp").distinct()
        way = tree_paths.join(ends, "grp").select("grp", F.lit(0).cast("long").alias("block"), "sides", "subroot", "root")
        way = way if found is None else way.unionByName(found.select(*way.columns))
        found = _extracted(log, way, last=tier == 0)
        if tier:
            found = written(found, "merkle-paths")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
