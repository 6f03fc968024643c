"""Token counts by byte-pair merging, without making identifiers.

A text is split into pieces; in each piece a heap holds the adjacent pairs by
rank and position and a linked list the symbols. The lowest pair is merged until
none is left: tokens = symbols at the start - merges. Counts of pieces are kept in
a bounded memo per worker process.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import text_of, worker_store
from eventflow.llm.pieces import OUTSIDE, PIECE, byte_letters, chunks

#: Pieces whose count a worker remembers; beyond it the memo starts anew. Only speed depends on it.
MEMO_PIECES = 800_000
POSITION_BITS = 32
ID_BITS = 24


class Merges:
    """The merge rules of a byte-level tokenizer file, by pair of symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.special = spec["model"], [t["content"] for t in spec.get("added_tokens", [])]
        numbers: dict[str, int] = {}
        number = lambda s: numbers.setdefault(s, len(numbers))
        self.letters = {c: number(c) for c in byte_letters()}
        self.bytes = [self.letters[c] for c in byte_letters()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(number(left) << ID_BITS | number(right), rank)
            self.merged.append(number(left + right))

    def count(self, symbols: list[int]) -> int:
        """How many symbols are left when no pair can be merged; ``symbols`` is used up."""
        n, rank, merged = len(symbols), self.rank.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            r << POSITION_BITS | i
            for i in range(n - 1)
            if (r := rank(symbols[i] << ID_BITS | symbols[i + 1])) is not None
        ]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            r, i = top >> POSITION_BITS, top & ((1 << POSITION_BITS) - 1)
            j = after[i]
            # An entry is out of date when its left symbol is gone or the pair has changed.
            if symbols[i] < 0 or j >= n or rank(symbols[i] << ID_BITS | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = merged[r], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] << ID_BITS | symbols[k])) is not None:
                    heappush(heap, r << POSITION_BITS | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << ID_BITS | symbols[i])) is not None:
                heappush(heap, r << POSITION_BITS | h)
        return n - merges


class Counter(dict):
    """Counts by piece; a missing piece is counted by merging."""

    def __init__(self, path: str):
        super().__init__()
        self.merges, self.path, self.split = Merges(path), path, None

    def __missing__(self, piece: str) -> int:
        symbols = self.merges.bytes
        n = self[piece] = self.merges.count([symbols[b] for b in piece.encode()])
        return n

    def outside(self, text: str) -> int:
        """A text beyond the plain set: the library's own pre-tokenizer splits it; merging is the same."""
        if self.split is None:
            from tokenizers import Tokenizer

            self.split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        letters = self.merges.letters
        return sum(self.merges.count([letters[c] for c in piece]) for piece, _ in self.split(text))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        for special in self.merges.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.text, parts))
        if OUTSIDE.search(text):
            return self.outside(text)
        if len(self) > MEMO_PIECES:
            self.clear()
        return sum(sum(map(self.__getitem__, PIECE.findall(part))) for part in chunks(text))


def counter(path: str) -> Counter:
    store = worker_store("counters")
    if path not in store:
        store[path] = Counter(path)
    return store[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes (UTF-8), n_tokens and over_limit.

    Null and empty texts have no bytes and no tokens. A null id is passed on; repeated
    rows are counted each; other columns are left out. ``tokenizer`` is a byte-level
    BPE file in the JSON form of the tokenizers library, readable at the same path on
    every executor.
    """

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counter(tokenizer)
        for batch in texts:
            yield pd.Series([counts.text(t) for t in batch], dtype="int64")

    text = text_of(text_col)
    counted = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
