"""Canonical, length-limited Huffman codes over token ids, coded and decoded in whole arrays."""

from __future__ import annotations

import numpy as np

#: No code is longer; a decoding table has 2 ** MOST_BITS entries at most.
MOST_BITS = 20
#: Symbols between two bit offsets of a block. They are where decoding can start.
CHECKPOINT = 128
LENGTH_BITS = 5


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Code length of each id, 0 where the count is 0, by package-merge: the best code with lengths up to ``most``."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    # One list per level, from the deepest: the ids and the packages of two from the level below, by weight.
    levels, below = [], np.empty(0)
    for _ in range(most):
        packages = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weight))
        below = both[order]
    take, depth = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for single in reversed(levels):
        singles = int(single[:take].sum())
        depth[:singles] += 1
        take = 2 * (take - singles)
    lengths[used] = depth
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int32)
        used = np.flatnonzero(lengths)
        self.order = used[np.lexsort((used, self.lengths[used]))]
        self.bits = int(self.lengths.max(initial=1))
        width = self.lengths[self.order]
        # Codes as numbers of ``bits`` bits, left aligned: each takes up 2 ** (bits - length) table entries.
        span = np.left_shift(1, self.bits - width)
        start = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (start >> (self.bits - width)).astype(np.uint64)
        entries = np.repeat((self.order << LENGTH_BITS) | width, span)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[: len(entries)] = entries

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Documents of ``sizes`` ids (each at least 1), one after the other, each from a whole byte on.

        Returns the bits, the bytes of each document, and the bit offset within its
        document of every CHECKPOINT-th id.
        """
        width = self.lengths[ids]
        # Positions fit 32 bits unless the documents are very long together.
        kind = np.int32 if len(ids) < (1 << 31) // (MOST_BITS + 8) else np.int64
        ends = np.cumsum(width, dtype=kind)
        last = np.cumsum(sizes)
        bits_before = np.r_[0, ends[last - 1]][: len(sizes)].astype(np.int64) if len(ids) else np.empty(0, np.int64)
        n_bytes = (np.diff(np.r_[bits_before, ends[-1:]]) + 7) // 8
        base = 8 * (np.cumsum(n_bytes) - n_bytes)
        start = ends - width + np.repeat((base - bits_before).astype(kind), sizes)
        word, place = start >> 6, start & 63
        room = 64 - place - width
        code = self.codes[ids]
        over = np.flatnonzero(room < 0)  # codes that reach into the next word, one per word at most
        room_over = room[over]
        room[over] = 0
        head = code << room.astype(np.uint64)
        head[over] = code[over] >> (-room_over).astype(np.uint64)
        total = int(n_bytes.sum())
        packed = np.zeros(total // 8 + 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            packed[word[first]] = np.bitwise_or.reduceat(head, first)
            packed[word[over] + 1] |= code[over] << (64 + room_over).astype(np.uint64)
        per_document, _ = stretches(sizes)
        number = np.arange(per_document.sum()) - np.repeat(np.cumsum(per_document) - per_document, per_document)
        at = np.repeat(last - sizes, per_document) + CHECKPOINT * number
        checkpoints = start[at] - np.repeat(base, per_document)
        return packed.astype(">u8").tobytes()[:total], n_bytes, checkpoints

    def decode(self, bits: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of all stretches, ``counts`` ids from each checkpoint (a bit offset) on.

        All stretches advance together, one table look-up per id.
        """
        data = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at, steps = checkpoints.astype(np.int64), int(counts.max(initial=0))
        out = np.zeros((steps, len(at)), np.int32)
        drop, limit = 32 - self.bits, len(window) - 1
        for step in range(steps):
            shifted = window[np.minimum(at >> 3, limit)] << (at & 7).astype(np.uint32)
            entry = self.table[shifted >> np.uint32(drop)]
            out[step] = entry
            at += entry & ((1 << LENGTH_BITS) - 1)
        return (out.T >> LENGTH_BITS)[np.arange(steps) < counts[:, None]]


def stretches(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checkpoints per document, and ids from each checkpoint on."""
    per_document = -(-sizes // CHECKPOINT)
    counts = np.full(int(per_document.sum()), CHECKPOINT, np.int64)
    counts[np.cumsum(per_document) - 1] = (sizes - 1) % CHECKPOINT + 1
    return per_document, counts
