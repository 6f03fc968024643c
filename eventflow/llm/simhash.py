"""Near-duplicates by SimHash fingerprints and vantage-point trees.

A 64-bit fingerprint is cut into blocks. Two fingerprints within the distance agree in
some block up to an even share of it, so each block's values are searched with that
small radius: a vantage-point tree divides them into shards, each fingerprint is stored
in its own shard and queries those that its ball overlaps. A shard compares whole
fingerprints exactly and returns a spanning forest of its links, closest pairs first,
not all pairs; the forests together connect what all pairs would.

Where links must be confirmed by the texts, a refused link may hide others in a forest, and
similar sets may have distant fingerprints. There the search is only the first step: what it
confirms is joined. What is still apart is searched without loss: in one order of all shingles,
rare ones first, two similar sets share one of their first shingles. Links of sets that meet
there tell the clusters, and within a cluster all pairs are compared by their shingle sets, which
are sent once to a task, so no table holds the pairs. Bits that tell sets apart for certain
keep the links of both steps to like texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import fresh, row_key, text_of, worker_store, written
from eventflow.llm.components import components
from eventflow.llm.vptree import tree

SEED = 42
BITS, BLOCKS = 64, 4
BLOCK = BITS // BLOCKS
#: Bits between fingerprints up to which trees are searched for texts; in wider balls a block prunes too little.
WIDEST = 15
#: Block values per shard at most. A constant, so what a fingerprint sends to shards does not grow with the data.
LEAF_VALUES = 32
#: Fingerprints stored in one part of a shard at most; a fuller shard is split.
PART_ROWS = 8192
PART_BITS = 24
#: Shard rows held, and pairs compared, at once.
BUFFER_ROWS = 100_000
PAIRS = 1 << 20
#: Leaves whose sets are searched in one task, and sets stored in one part of them at most.
GROUP_LEAVES = 512
GROUP_ROWS = 1 << 18
#: Bits of a set's parities at least and at most, and pairs whose parities are compared at once.
LEAST_PARITIES, MOST_PARITIES = 64, 1 << 14
PARITY_PAIRS = 1 << 14
#: Shingles in one block of a cluster, of which a task holds two.
TILE_SHINGLES = 1 << 21
#: Shingles whose bits are added up at once.
SHINGLES = 1 << 16
#: Shingles counted at once, sets that hold a common one at least, and common ones that the order of shingles knows.
COUNTED = 1 << 19
COMMON, MOST_COMMON = 100, 1 << 15
#: Bytes of rows held at once where parities come with them.
BUFFER_BYTES = 8 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each run of ``words`` words, repeats included; A-Z count as a-z.

    Words end at ASCII white space. A text with fewer words is one shingle; without words there is none.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda end, n: end + 1 + n))
    starts = [0, *[end + 1 for end in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as an unsigned number; zero without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), SHINGLES):
        part = np.ascontiguousarray(hashes[start : start + SHINGLES], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def set_id(distinct: np.ndarray) -> int:
    """One number for a shingle set, given in order."""
    return xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED)


def parities_of(distinct: np.ndarray) -> bytes:
    """For each remainder of the distinct hashes, whether an odd number has it; about a bit for each hash.

    Two sets differ in at least as many hashes as such bits. The first half of the bits added to the
    second are those of half as many remainders.
    """
    bits = min(max(LEAST_PARITIES, 1 << max(len(distinct) - 1, 0).bit_length()), MOST_PARITIES)
    odd = np.bincount((distinct & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many parities differ in each pair, in as many bits as the shorter one has."""
    out = np.zeros(len(a), np.int64)
    long, short = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    for la, lb in {*zip(long.tolist(), short.tolist())}:
        own = np.flatnonzero((long == la) & (short == lb))
        least = min(la, lb)
        for at in range(0, len(own), PARITY_PAIRS):
            some = own[at : at + PARITY_PAIRS]
            x, y = (np.frombuffer(b"".join(z[some]), np.uint8).reshape(len(some), -1, least) for z in (a, b))
            x, y = np.bitwise_xor.reduce(x, axis=1), np.bitwise_xor.reduce(y, axis=1)
            out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def fingerprint(text: Column, words: int) -> Column:
    """The fingerprint of a text as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = [fingerprint_of(shingle_hashes(t, words)) for t in batch]
            yield pd.Series(np.array(found, np.uint64).view(np.int64))

    return of(text)


def forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Indices of links that connect what all links connect, without cycles, closest first."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root, kept = np.arange(len(nodes)), []
    for d in np.unique(distance):
        open_links = np.flatnonzero(distance == d)
        while True:
            x, y = root[left[open_links]], root[right[open_links]]
            apart = x != y
            open_links, x, y = open_links[apart], x[apart], y[apart]
            if not len(open_links):
                break
            # Each larger root hangs itself under one smaller root, so no cycle can close.
            high, first = np.unique(np.maximum(x, y), return_index=True)
            kept.append(open_links[first])
            root[high] = np.minimum(x, y)[first]
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _hits(stored: np.ndarray, first: np.ndarray, count: np.ndarray, query: np.ndarray, most: int):
    """Forest of the links between each query and ``count`` stored fingerprints from ``first`` on."""
    links = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint8))]
    ends = np.cumsum(count)
    start = 0
    while start < len(query):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        counts = count[start:stop]
        q = np.repeat(query[start:stop], counts)
        skip = np.repeat(first[start:stop] - (ends[start:stop] - counts - base), counts)
        s = stored[skip + np.arange(len(q))]
        d = np.bitwise_count(q ^ s)
        near = (d <= most) & (q != s)
        q, s, d = q[near], s[near], d[near]
        kept = forest(q, s, d)
        links.append((q[kept], s[kept], d[kept]))
        start = stop
    a, b, d = (np.concatenate(x) for x in zip(*links))
    kept = forest(a, b, d)
    return a[kept], b[kept], d[kept]


def _search(most: int):
    """Compares the queries of each part with its stored fingerprints; rows come sorted by part, stored first."""

    def rows(found) -> pa.RecordBatch:
        a, b, d = found
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32))], ["a", "b", "distance"]
        )

    def compare(part: np.ndarray, query: np.ndarray, value: np.ndarray):
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(part)]))
        stored = np.bincount(group, weights=~query, minlength=len(starts)).astype(np.int64)
        return _hits(value, starts[group[query]], stored[group[query]], value[query], most)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, query, value = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64)
        for batch in batches:
            part = np.concatenate([part, batch.column(0).to_numpy()])
            query = np.concatenate([query, batch.column(1).to_numpy(zero_copy_only=False)])
            value = np.concatenate([value, batch.column(2).to_numpy().view(np.uint64)])
            if len(part) < BUFFER_ROWS:
                continue
            last = int(np.searchsorted(part, part[-1]))
            if last:
                yield rows(compare(part[:last], query[:last], value[:last]))
            else:  # one part fills the buffer: its queries so far are done, the stored ones stay
                yield rows(compare(part, query, value))
                keep = ~query
                part, query, value = part[keep], query[keep], value[keep]
                continue
            part, query, value = part[last:], query[last:], value[last:]
        if len(part):
            yield rows(compare(part, query, value))

    return search


def links(prints: DataFrame, most: int) -> DataFrame:
    """Links a, b, distance that connect all fingerprints at up to ``most`` differing bits.

    ``prints`` has one column ``fp`` of distinct longs. Every pair within the distance is
    connected by a path of such links. A pair can come more than once.
    """
    radius, leaf_values = most // BLOCKS, LEAF_VALUES

    def shards_of(values: np.ndarray):
        """(shard, query?, index) of each fingerprint, block by block."""
        divided = tree(BLOCK, leaf_values, radius)
        for block in range(BLOCKS):
            part = ((values >> np.uint64(BLOCK * block)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
            base = block * divided.leaves
            yield base + divided.leaf[part], False, np.arange(len(values))
            first, count = divided.first[part], divided.first[part + 1] - divided.first[part]
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)
            yield base + divided.visited[at].astype(np.int64), True, np.repeat(np.arange(len(values)), count)

    def own_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            found = np.concatenate([shard for shard, query, _ in shards_of(values) if not query])
            shard, count = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(count)], ["shard", "n"])

    # Shards too full for one part; there are BLOCKS << BLOCK shards at most.
    full = prints.mapInArrow(own_shards, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    parts = {r["shard"]: -(-r["n"] // PART_ROWS) for r in full.where(F.col("n") > PART_ROWS).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.array(sorted(parts), np.int64)
        into = np.array([parts[s] for s in sorted(parts)], np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for shard, query, index in shards_of(values):
                n = np.ones(len(shard), np.int64)
                if len(split):
                    at = np.minimum(np.searchsorted(split, shard), len(split) - 1)
                    n = np.where(split[at] == shard, into[at], 1)
                if query:  # to every part of the shard
                    shard, index, n = np.repeat(shard, n), np.repeat(index, n), n
                    part = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n)
                else:  # to one part
                    part = (((values[index] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % n.astype(np.uint64)).astype(np.int64)
                for start in range(0, len(shard), BUFFER_ROWS):
                    end = start + BUFFER_ROWS
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((shard[start:end] << PART_BITS) + part[start:end]),
                            pa.array(np.full(len(shard[start:end]), query)),
                            pa.array(values[index[start:end]].view(np.int64)),
                        ],
                        ["part", "query", "fp"],
                    )

    dealt = prints.mapInArrow(deal, "part long, query boolean, fp long")
    together = dealt.repartition("part").sortWithinPartitions("part", "query")
    return together.mapInArrow(_search(most), "a long, b long, distance int")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id.

    Rows link when their fingerprints differ in at most ``most`` bits; component_id is the
    smallest id that can be reached. Null and empty texts have fingerprint zero and
    link like any other. Null ids are never the smallest (a component of null ids alone
    has none). Repeated rows are rows of their own; an empty table has an empty result.
    """
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_of(text_col), words).alias("fp")), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), most))
    members = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    members = written(members, "fingerprint-roots")
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(members.join(named, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _grouped(radius: int, leaf_values: int):
    """(tree, groups, first): a value's visited leaves in group g lie from first[value * groups + g] to the next entry's."""
    divided = tree(BLOCK, leaf_values, radius)
    store = worker_store("vantage-trees")
    key = ("groups", radius, leaf_values, GROUP_LEAVES)
    if key not in store:
        groups = -(-divided.leaves // GROUP_LEAVES)
        first = np.zeros((groups << BLOCK) + 1, np.int32)
        step = 1 << 12
        for low in range(0, 1 << BLOCK, step):  # a part of the values at a time, which bounds the worker's memory
            bounds = divided.first[low : low + step + 1]
            value = np.repeat(np.arange(step), np.diff(bounds))
            counts = np.bincount(value * groups + divided.visited[bounds[0] : bounds[-1]] // GROUP_LEAVES, minlength=groups * step)
            first[low * groups + 1 : (low + step) * groups + 1] = bounds[0] + np.cumsum(counts)
        store[key] = groups, first
    return divided, *store[key]


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of each entry of the ranges of ``count`` entries from ``first`` on."""
    return np.repeat(np.arange(len(count)), count), np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def near_pairs(sets: DataFrame, most: int, similarity: float, every: bool) -> DataFrame:
    """Pairs a, b of ids with different roots, at up to ``most`` differing bits, whose sizes allow the similarity.

    ``sets`` has columns fp, id, size and root, with distinct ids; fingerprints may
    repeat. Where it has ``parities`` too, pairs whose sets these show to differ too much are left out.
    With ``every`` all such pairs come, else links that connect what they
    connect, closest first. A pair can come more than once.
    """
    radius, leaf_values, group_rows = most // BLOCKS, LEAF_VALUES, GROUP_ROWS
    columns = ["fp", "id", "size", "root", *(["parities"] if "parities" in sets.columns else [])]
    apart_at_most = (1 - similarity) / (1 + similarity)

    def own(values: np.ndarray) -> np.ndarray:
        divided, groups, _ = _grouped(radius, leaf_values)
        blocks = [divided.leaf[_block(values, b)] // GROUP_LEAVES + b * groups for b in range(BLOCKS)]
        return np.concatenate(blocks)

    def own_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, count = np.unique(own(batch.column(0).to_numpy().view(np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(count)], ["shard", "n"])

    full = sets.select("fp").mapInArrow(own_shards, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    parts = {r["shard"]: -(-r["n"] // group_rows) for r in full.where(F.col("n") > group_rows).collect()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divided, groups, first = _grouped(radius, leaf_values)
        into = np.ones(BLOCKS * groups, np.int64)
        for shard, n in parts.items():
            into[shard] = n
        for batch in batches:
            values, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for block in range(BLOCKS):
                value = _block(values, block)
                stored = divided.leaf[value] // GROUP_LEAVES + block * groups
                part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % into[stored]
                sent = [((stored << PART_BITS) + part, np.arange(len(values)), False)]
                some = first[(value * groups)[:, None] + np.arange(groups + 1)]
                index, group = np.nonzero(np.diff(some, axis=1))
                shard = group + block * groups
                owner, part = _ranges(np.zeros(len(shard), np.int64), into[shard])
                sent.append(((shard[owner] << PART_BITS) + part, index[owner], True))
                for part, index, query in sent:
                    for at in range(0, len(part), BUFFER_ROWS):
                        take = pa.array(index[at : at + BUFFER_ROWS])
                        flags = pa.array(np.full(len(take), query))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part[at : at + BUFFER_ROWS]), flags, *[batch.column(c).take(take) for c in range(len(columns))]],
                            ["part", "query", *columns],
                        )

    def compare(part: int, stored: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """``stored`` is in order of leaf and size, with that order's key in front."""
        divided, groups, first = _grouped(radius, leaf_values)
        block, group = divmod(part >> PART_BITS, groups)
        key, fp, ids, size, root, *parities = stored
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))]
        at = _block(queries[0], block) * groups + group
        visits = first[at + 1] - first[at]
        for low, high in _portions(visits, PAIRS):
            query, entry = _ranges(first[at[low:high]], visits[low:high])
            query += low
            leaf = divided.visited[entry].astype(np.int64) << 32
            n = queries[2][query].astype(np.int64)
            begin = np.searchsorted(key, leaf + np.ceil(similarity * n - 1e-6).astype(np.int64))
            end = np.searchsorted(key, leaf + np.minimum(np.floor(n / similarity + 1e-6), (1 << 32) - 1).astype(np.int64), "right")
            for some, rest in _portions(end - begin, PAIRS):
                owner, s = _ranges(begin[some:rest], (end - begin)[some:rest])
                q = query[some:rest][owner]
                near = np.flatnonzero(np.bitwise_count(queries[0][q] ^ fp[s]) <= most)
                q, s = q[near], s[near]
                apart = queries[3][q] != root[s]
                q, s = q[apart], s[apart]
                if parities and len(q):
                    alike = _differing(queries[4][q], parities[0][s]) <= apart_at_most * (queries[2][q] + size[s]) + 1e-6
                    q, s = q[alike], s[alike]
                found = queries[1][q], ids[s], np.bitwise_count(queries[0][q] ^ fp[s])
                if every:
                    if len(q):
                        yield pairs_of(*found)
                elif len(q):
                    kept.append(tuple(x[forest(*found)] for x in found))
        if not every:
            a, b, d = (np.concatenate(x) for x in zip(*kept))
            links = forest(a, b, d)
            yield pairs_of(a[links], b[links], d[links])

    def pairs_of(a: np.ndarray, b: np.ndarray, _) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, index, queries, held = None, [], None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal index, stored
            if not queries or not stored and index is None:
                return
            if index is None:
                divided, groups, _ = _grouped(radius, leaf_values)
                whole = [np.concatenate(x) for x in zip(*stored)]
                key = (divided.leaf[_block(whole[0], (now >> PART_BITS) // groups)] << 32) + whole[2]
                order = np.argsort(key, kind="stable")
                index, stored = [key[order], *[x[order] for x in whole]], []
            yield from compare(now, index, [np.concatenate(x) for x in zip(*queries)])

        for batch in batches:
            part, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            values = [batch.column(c + 2).to_numpy(zero_copy_only=False) for c in range(len(columns))]
            values[0] = values[0].view(np.uint64)
            cuts = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1, len(part)]
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if low == high:
                    continue
                if part[low] != now:
                    yield from done()
                    now, stored, index, queries, held = int(part[low]), [], None, [], 0
                (queries if query[low] else stored).append([x[low:high] for x in values])
                held += high - low if query[low] else 0
                if held >= BUFFER_ROWS:
                    yield from done()
                    queries, held = [], 0
        yield from done()

    given = "part long, query boolean, fp long, id long, size long, root long" + (", parities binary" if len(columns) > 4 else "")
    dealt = sets.select(*columns).mapInArrow(deal, given)
    together = dealt.repartition("part").sortWithinPartitions("part", "query")
    return together.mapInArrow(search, "a long, b long").distinct()


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The most common shingles of a column of texts, rarest first.

    Counted are those that come twice among ``COUNTED`` shingles. The order of shingles made of them
    decides how fast similar sets are found, not which.
    """
    at_once, least, most = COUNTED, COMMON, MOST_COMMON

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def repeated() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            several = count > 1
            return pa.RecordBatch.from_arrays([pa.array(found[several].view(np.int64)), pa.array(count[several])], ["shingle", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(np.unique(shingle_hashes(text, words)))
                n += len(held[-1])
                if n >= at_once:
                    yield repeated()
                    held, n = [], 0
        if held:
            yield repeated()

    counts = texts.mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").collect()
    return np.array([r["shingle"] for r in reversed(found)], np.int64).view(np.uint64)


def first_shingles(distinct: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """As many of a set's first shingles as hold one of every set that is similar enough.

    First come by value those that are not in ``common`` (in order, with their ``rank``), then the others by rank.
    """
    n = len(distinct)
    needed = min(n, n - int(np.ceil(similarity * n - 1e-6)) + 1)
    if not len(common):
        return distinct[:needed]
    at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
    is_common = common[at] == distinct
    rare = distinct[~is_common]
    if len(rare) >= needed:
        return rare[:needed]
    return np.concatenate([rare, distinct[is_common][np.argsort(rank[at[is_common]])]])[:needed]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by their first column, in tables between which no value of it is divided."""
    held, rows, size, times = [], 0, 0, 1
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < times * BUFFER_ROWS and size < times * BUFFER_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        other = np.flatnonzero(key != key[-1])
        if not len(other):  # one group fills the buffer
            times *= 2
            continue
        yield table.slice(0, last := int(other[-1]) + 1)
        rest = table.slice(last).take(pa.array(np.arange(len(key) - last)))  # a copy, which frees the others
        held, rows, size, times = rest.to_batches(), rest.num_rows, rest.nbytes, 1
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def meeting_links(sets: DataFrame, beginnings: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that connect all ids of similar sets with different roots.

    ``sets`` has columns id, size, root and parities, ``beginnings`` id and first, the ``first_shingles``
    in order. Sets meet at a shared one. What two sets hold before the first that they share is in one of them
    only, so its places are bounded by how much the sets may differ. Of the pairs left by that the parities decide.
    """
    apart_at_most = (1 - similarity) / (1 + similarity)

    def possible(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs that share a shingle and are not excluded by root, size or place."""
        shingle, root, size, place = (group[c].to_numpy().astype(np.int64) for c in ("shingle", "root", "size", "place"))
        number = np.cumsum(np.r_[False, shingle[1:] != shingle[:-1]]) << 32
        order = np.argsort(number + size, kind="stable")
        key, number = (number + size)[order], number[order]
        most = np.minimum(np.floor(size[order] / similarity + 1e-6), (1 << 32) - 1).astype(np.int64)
        later = np.searchsorted(key, number + most, "right") - np.arange(len(key)) - 1
        for low, high in _portions(later, PAIRS // 4):
            owner, other = _ranges(np.arange(low, high) + 1, later[low:high])
            a, b = order[owner + low], order[other]
            fits = np.flatnonzero((root[a] != root[b]) & (place[a] + place[b] <= apart_at_most * (size[a] + size[b]) + 1e-6))
            yield a[fits], b[fits]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches):
            met = np.zeros(group.num_rows, bool)
            for a, b in possible(group):
                met[a] = met[b] = True
            yield from group.filter(pa.array(met)).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches):
            ids, size, parities = (group[c].to_numpy() for c in ("id", "size", "parities"))
            kept = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for a, b in possible(group):
                if len(a):
                    alike = _differing(parities[a], parities[b]) <= apart_at_most * (size[a] + size[b]) + 1e-6
                    a, b = ids[a[alike]], ids[b[alike]]
                    some = forest(a, b, np.zeros(len(a), np.uint8))
                    kept.append((a[some], b[some]))
            a, b = (np.concatenate(x) for x in zip(*kept))
            some = forest(a, b, np.zeros(len(a), np.uint8))
            a, b = a[some], b[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    given = "shingle long, id long, root long, size long, place int"
    rows = sets.select("id", "root", "size").join(beginnings, "id")
    rows = rows.select("id", "root", "size", F.posexplode("first").alias("place", "shingle")).select("shingle", "id", "root", "size", "place")
    met = written(rows.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(meet, given), "meetings")
    met = met.join(sets.select("id", "parities"), "id").select("shingle", "id", "root", "size", "place", "parities")
    return met.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(link, "a long, b long").distinct()


def similar_pairs(clusters: DataFrame, sets: DataFrame, most: int, similarity: float) -> DataFrame:
    """Links a, b that connect all ids of a cluster whose fingerprints and sets are alike and that have different roots.

    ``clusters`` has columns fp, id, size, root and cluster, ``sets`` id and shingles. Every pair of a
    cluster is compared. Small clusters share a task; one with many shingles is cut into blocks,
    and a task compares two of them.
    """
    tile = TILE_SHINGLES
    weights = clusters.groupBy("cluster").agg(F.ceil((F.sum("size") + F.count("*")) / tile).alias("blocks"), F.sum("size").alias("weight"))
    weights = written(weights, "cluster-weights")
    bundles = 1 + (weights.agg(F.sum("weight")).first()[0] or 0) // tile
    placed = clusters.join(weights, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    alone = F.col("blocks") > 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.when(alone, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(bundles))).alias("home"),
        F.when(alone, F.least("block", "other")).otherwise(-1).alias("low"),
        F.when(alone, F.greatest("block", "other")).otherwise(-1).alias("high"),
        *["cluster", "block", "fp", "id", "size", "root"],
    )

    def linked(group: pa.Table) -> pa.Table:
        cluster, block, fp, ids, size, root = (group[c].to_numpy() for c in ("cluster", "block", "fp", "id", "size", "root"))
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        shingles = pa.concat_arrays(group["shingles"].chunks)
        count = shingles.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(count) - count
        codes = np.unique(shingles.flatten().to_numpy(), return_inverse=True)[1]
        marked = np.zeros(len(codes) + 1, bool)
        joined = np.unique(root, return_inverse=True)[1]
        a, b = [], []
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            left, right = (rows, rows) if low == high else (rows[block[rows] == low], rows[block[rows] == high])
            for k, x in enumerate(left.tolist()):
                others = right[k + 1 :] if low == high else right
                fits = (joined[others] != joined[x]) & (np.bitwise_count(fp[others] ^ fp[x]) <= most)
                fits &= np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x]) - 1e-6
                others = others[fits]
                if not len(others):
                    continue
                own = codes[first[x] : first[x] + count[x]]
                marked[own] = True
                for start, stop in _portions(count[others], PAIRS):
                    some = others[start:stop]
                    owner, at = _ranges(first[some], count[some])
                    shared = np.bincount(owner, marked[codes[at]], minlength=len(some)).astype(np.int64)
                    for y in some[shared >= similarity * (count[x] + count[some] - shared)].tolist():
                        if joined[y] != joined[x]:
                            a.append(min(ids[x], ids[y]))
                            b.append(max(ids[x], ids[y]))
                            members = rows[joined[rows] == joined[y]]
                            joined[members] = joined[x]
                marked[own] = False
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.join(sets, "id").groupBy("home", "low", "high").applyInArrow(linked, "a long, b long")


def _block(values: np.ndarray, block: int) -> np.ndarray:
    return ((values >> np.uint64(BLOCK * block)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)


def _portions(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries whose counts add up to ``most`` at most, or of one entry."""
    ends, start = np.cumsum(counts), 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop
        start = stop


def one_of_each(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 15, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` less near copies: of each group the row with the smallest id stays.

    Rows link when their fingerprints differ in ``most`` bits at most and the Jaccard
    similarity of their sets of ``words``-word shingles is at least ``similarity``, or
    when the sets are equal. With ``most=BITS`` the similarity alone decides. Null and empty texts have no shingles and equal each other. Of repeated
    rows (same id and text) all stay or go together; a null id counts as larger than any other.
    """
    at = fresh("row_node", docs.columns)
    identity, content = row_key(id_col, text_col)
    # One text per row that sorts by id, nulls last, then by the hash of the text.
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    by_id = digits(F.coalesce(identity.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))))
    node = F.concat(F.when(identity.isNull(), "1").otherwise("0"), by_id, digits(content))

    @F.pandas_udf("fp long, id long, size long, parities binary")
    def described(texts: pd.Series) -> pd.DataFrame:
        out, parities = [], []
        for t in texts:
            # Like the similarity, the fingerprint is one of distinct shingles: repeats in a text change neither.
            distinct = np.unique(shingle_hashes(t, words))
            out.append((fingerprint_of(distinct), set_id(distinct), len(distinct)))
            parities.append(parities_of(distinct))
        found = np.array(out, np.uint64).reshape(-1, 3).view(np.int64)
        return pd.DataFrame({"fp": found[:, 0], "id": found[:, 1], "size": found[:, 2], "parities": pd.Series(parities, dtype=object)})

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words)).view(np.int64) for t in texts])

    rows = written(docs.select(node.alias("node"), described(text_of(text_col)).alias("x")).select("node", "x.*"), "fingerprints")
    # Rows with equal shingle sets are one; different sets stay apart, also under one fingerprint.
    classes = rows.groupBy("id").agg(F.min("fp").alias("fp"), F.first("size").alias("size"), F.min("node").alias("first"), F.min("parities").alias("parities"))
    classes = written(classes, "shingle-classes")
    whole = docs.select(node.alias("node"), text_of(text_col).alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """The shingle set of each id, once."""
        needed = classes.join(ids, "id", "left_semi").select("id", F.col("first").alias("node"))
        sets = whole.join(needed, "node").dropDuplicates(["id"]).select("id", shingles("text").alias("shingles"))
        return written(sets, "shingle-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs a, b that are similar enough."""
        pairs = written(pairs, "candidates")
        sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - shared
        return written(both.where(shared >= F.lit(similarity) * union).select("a", "b"), "confirmed")

    # A first, cheap step joins most copies. Of what is still apart every similar set is in one cluster
    # with its partner, whatever their fingerprints, and all pairs of a cluster are tested, so no refused link hides another.
    joined = confirmed(near_pairs(classes.withColumn("root", F.col("id")), min(most, WIDEST), similarity, every=False))
    roots = components(joined).withColumnRenamed("node", "id")
    apart = classes.join(roots, "id", "left").select("fp", "id", "size", F.coalesce("root", "id").alias("root"), "parities")
    apart = written(apart, "shingle-roots")
    common = common_shingles(docs.select(text_of(text_col).alias("text")), words)
    rank = np.argsort(common)
    common = common[rank]

    def beginning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
            ids = np.array([set_id(distinct) for distinct in sets], np.uint64).view(np.int64)
            first = [first_shingles(distinct, common, rank, similarity).view(np.int64) for distinct in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first, pa.list_(pa.int64()))], ["id", "first"])

    begun = docs.select(text_of(text_col).alias("text")).mapInArrow(beginning, "id long, first array<long>").dropDuplicates(["id"])
    tops = components(meeting_links(apart, begun, similarity)).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    tops = tops.unionByName(tops.select(F.col("cluster").alias("id"), "cluster").distinct())
    clusters = written(apart.drop("parities").join(tops, "id"), "shingle-clusters")
    links_within = similar_pairs(clusters, sets_of(clusters.select("id")), most, similarity)
    joined = joined.unionByName(written(links_within, "confirmed"))
    named = classes.select(F.col("id").alias("a"), F.col("first").alias("left"))
    other = classes.select(F.col("id").alias("b"), F.col("first").alias("right"))
    between = joined.join(named, "a").join(other, "b").select(F.col("left").alias("a"), F.col("right").alias("b"))
    within = rows.join(classes.select("id", "first"), "id").select(F.col("first").alias("a"), F.col("node").alias("b"))
    gone = components(between.unionByName(within)).select(F.col("node").alias(at))
    return docs.withColumn(at, node).join(gone, at, "left_anti").select(*docs.columns)
