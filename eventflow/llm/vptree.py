"""A vantage-point tree over short bit blocks under Hamming distance.

The tree covers all values of a block, so it is the same on every worker and needs no
data. A node holds a vantage point and the median distance from it; values within go
left, the others right. A search for all values within a radius follows a branch only
if the triangle inequality leaves it open; the leaves it reaches are the shards whose
boundary the query's ball overlaps.
"""

from __future__ import annotations

import numpy as np

from eventflow.llm.common import worker_store


class VantageTree:
    """``leaf`` of each value, and for each value the leaves that its ball overlaps, up to its own.

    Two values within the radius overlap each other's leaves, so the one whose leaf has
    the higher number visits the other: looking at leaves up to one's own loses nothing.
    """

    def __init__(self, bits: int, leaf_values: int, radius: int, seed: int = 1):
        self.bits, self.leaf_values, self.radius = bits, leaf_values, radius
        self.random = np.random.default_rng(seed)
        # Values and leaf numbers take 16 bits each: at radius 3 there are ten million visits.
        values = np.arange(1 << bits, dtype=np.uint16)
        self.leaf = np.full(1 << bits, -1, np.int64)
        visitors: list[np.ndarray] = []
        self._grow(values, values, visitors)
        self.leaves = len(visitors)
        counts = np.zeros(1 << bits, np.int64)
        for queries in visitors:
            counts[queries] += 1
        self.first = np.r_[0, np.cumsum(counts)]
        self.visited = np.empty(self.first[-1], np.uint16)
        at = self.first[:-1].copy()
        for leaf, queries in enumerate(visitors):
            self.visited[at[queries]] = leaf
            at[queries] += 1

    def _grow(self, values: np.ndarray, queries: np.ndarray, visitors: list[np.ndarray]) -> None:
        """Builds the node of ``values``; ``queries`` are all values whose ball may reach into it."""
        if len(values) > self.leaf_values:
            vantage = values[self.random.integers(len(values))]
            distance = np.bitwise_count(values ^ vantage).astype(np.int64)
            median = int(np.median(distance))
            if median == distance.max():
                median -= 1
            near = distance <= median
            reach = np.bitwise_count(queries ^ vantage).astype(np.int64)
            self._grow(values[near], queries[reach - self.radius <= median], visitors)
            self._grow(values[~near], queries[reach + self.radius > median], visitors)
            return
        self.leaf[values] = len(visitors)
        # Values whose own leaf came earlier don't visit; of the rest the bounds let some through that reach nothing.
        queries = queries[(self.leaf[queries] < 0) | (self.leaf[queries] == len(visitors))]
        reached = np.zeros(len(queries), bool)
        for value in values:
            reached |= np.bitwise_count(queries ^ value) <= self.radius
        visitors.append(queries[reached])


def tree(bits: int, leaf_values: int, radius: int) -> VantageTree:
    """The worker's tree of that kind."""
    store = worker_store("vantage-trees")
    key = (bits, leaf_values, radius)
    if key not in store:
        store[key] = VantageTree(*key)
    return store[key]
