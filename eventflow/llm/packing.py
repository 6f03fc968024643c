"""Packing token sequences into windows of fixed size by best-fit decreasing.

Documents are tokenized and cut into full windows and one shorter rest. The pieces
are dealt by a hash of the row into groups of bounded size; each group is packed by
itself, longest piece first, each into the tightest open window that still holds
it. A segment tree over remaining capacities finds that window. More groups cost a
few part-filled windows each, so the padding does not grow with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.llm.common import text_of, written
from eventflow.llm.pieces import encoder

#: Pieces packed together in one task.
GROUP_ROWS = 20_000
#: Tokens packed together in one task, where the ids come along: 64 MB.
GROUP_TOKENS = 1 << 24
GROUP_BITS = 32
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
SEQUENCES = "sequence_id long, n_tokens long, ids binary, pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
SLICES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    short: bool = False,
) -> DataFrame:
    """The documents' ids in pieces of at most ``window``: doc_id, start, length, doc_tokens, ids.

    ``ids`` holds little-endian unsigned 32-bit numbers; with ``short`` 16-bit ones, where
    the tokenizer's ids fit them. Each document ends with ``end_id``; null and empty texts
    consist of it alone (without an end id they have no piece). Null ids and repeated rows
    are kept as rows of their own.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        kind = np.dtype(encode.dtype if short else "<u4")
        size = kind.itemsize
        for batch in batches:
            keys, starts, lengths, totals, ids = [], [], [], [], []
            for key, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                data = np.frombuffer(data, encode.dtype)
                data = (data if end_id is None else np.append(data, end_id)).astype(kind).tobytes()
                n = len(data) // size
                for start in range(0, n, window):
                    part = data[size * start : size * (start + window)]
                    keys.append(key)
                    starts.append(start)
                    lengths.append(len(part) // size)
                    totals.append(n)
                    ids.append(part)
            longs = [pa.array(x, pa.int64()) for x in (keys, starts, lengths, totals)]
            yield pa.RecordBatch.from_arrays(
                [*longs, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"]
            )

    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(pieces, PIECES)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, remaining: int, window: int) -> None:
        self.windows[remaining].append(window)
        if len(self.windows[remaining]) == 1:
            node = self.width + remaining
            while node:
                self.tree[node] += 1
                node >>= 1

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the window with the least remaining capacity of at least ``size``."""
        node = self.width + size
        if not self.tree[node]:
            # Up to the first ancestor with an occupied right neighbour, then down its left edge.
            while node > 1 and not (node % 2 == 0 and self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        remaining = node - self.width
        window = self.windows[remaining].pop()
        if not self.windows[remaining]:
            while node:
                self.tree[node] -= 1
                node >>= 1
        return remaining, window


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces must come in order of falling length."""
    window, offset, opened, space = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, OpenWindows(capacity)
    for i, size in enumerate(lengths.tolist()):
        found = space.tightest(size)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        remaining, window[i] = found
        offset[i] = capacity - remaining
        if remaining > size:
            space.add(remaining - size, int(window[i]))
    return window, offset


def place(pieces: DataFrame, capacity: int = 2048, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, gapless from 0 within each sequence.

    Every piece must have a ``length`` from 1 to ``capacity``. Ties are broken by
    ``doc_id`` (nulls first) and ``start``. Further columns are carried along; columns
    named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // group_rows))
    columns = pieces.columns
    group = F.pmod(F.xxhash64(*[c for c in ("doc_id", "start", "length", "ids_crc32") if c in columns]), F.lit(groups))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        rows = rows.select(columns).take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
        window, offset = best_fit(rows["length"].to_numpy(), capacity)
        window += key[0].as_py() << GROUP_BITS
        return rows.append_column("sequence_id", pa.array(window)).append_column("offset", pa.array(offset))

    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return pieces.groupBy(group.alias("group")).applyInArrow(pack, schema)


def padding(sequence_length, capacity: int = 2048):
    """Padded positions of a sequence: none at a power of two, else up to ``capacity``."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(sequence_length.cast("double")))).cast("long")
    return F.when(power == sequence_length, 0).otherwise(capacity - sequence_length)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary, padded), from pieces placed with their ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # one window's pieces: at most ``capacity`` rows
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))

    @F.pandas_udf("binary")
    def joined(parts: pd.Series, pads: pd.Series) -> pd.Series:
        pad = np.array([pad_id], "<u4").tobytes()
        return pd.Series([b"".join(bytes(p["ids"]) for p in row) + pad * int(n) for row, n in zip(parts, pads)])

    return whole.select("sequence_id", "n_tokens", joined("parts", padding(F.col("n_tokens"), capacity)).alias("ids"))


def assembled(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The padded sequences of pieces from ``cut``: sequence_id, n_tokens, ids, and the pieces in order of their offset.

    They are placed as in ``place`` and joined where they are placed, so the ids are shuffled
    once; pieces may hold 16-bit ids, the sequences hold 32-bit ones. A column ``spread`` (a
    number of the row) deals repeats of one row to different groups. Null ids are ids like
    any other; an empty table has an empty result.
    """
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-n // group_rows), -(-tokens // GROUP_TOKENS))
    spread = ["spread"] if "spread" in pieces.columns else ["doc_id", "start", "length", "ids"]
    group = F.pmod(F.xxhash64(*spread), F.lit(groups))
    pad = np.array([pad_id], "<u4").tobytes()

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        index = pc.sort_indices(rows, sort_keys=order, null_placement="at_start").to_numpy()
        window, offset = best_fit(rows["length"].to_numpy()[index], capacity)
        by_window = np.lexsort((offset, window))
        window, offset, index = window[by_window], offset[by_window], index[by_window]
        rows = rows.take(pa.array(index))
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        ends = np.cumsum(rows["length"].to_numpy())
        ends = ends[np.r_[first[1:], len(window)] - 1]
        lengths = np.diff(np.r_[0, ends])
        data, whole = b"".join(rows["ids"].to_pylist()), []
        if len(data) < 4 * int(ends[-1]):
            data = np.frombuffer(data, "<u2").astype("<u4").tobytes()
        for end, length in zip(ends.tolist(), lengths.tolist()):
            padded = 0 if length & (length - 1) == 0 else capacity - length
            whole.append(data[4 * (end - length) : 4 * end] + pad * padded)
        columns = [rows[c].combine_chunks() for c in ("doc_id", "start", "length", "doc_tokens")]
        parts = pa.StructArray.from_arrays([*columns, pa.array(offset)], ["doc_id", "start", "length", "doc_tokens", "offset"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(window)], pa.int32()), parts)
        numbers = window[first] + (key[0].as_py() << GROUP_BITS)
        return pa.table([pa.array(numbers), pa.array(lengths), pa.array(whole, pa.binary()), lists], ["sequence_id", "n_tokens", "ids", "pieces"])

    return pieces.groupBy(group.alias("group")).applyInArrow(pack, SEQUENCES)


def slices(whole: DataFrame) -> DataFrame:
    """A row per piece of assembled sequences, with the CRC-32 of the ids that stand at its place."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sequence, ids, parts in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                for p in parts:
                    part = ids[4 * p["offset"] : 4 * (p["offset"] + p["length"])]
                    rows.append((p["doc_id"], p["start"], len(part) // 4, zlib.crc32(part), p["doc_tokens"], sequence, p["offset"]))
            names = [field.split()[0] for field in SLICES.split(", ")]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return whole.select("sequence_id", "ids", "pieces").mapInArrow(cut_out, SLICES)


def packed(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = 1) -> DataFrame:
    """The documents' padded sequences, written to the shared folder, as a row per piece read back out of them.

    Null and empty texts are the end id alone, null ids and repeated rows are rows of their
    own, an empty table has an empty result.
    """
    pieces = cut(docs, tokenizer, window, end_id, short=True)
    pieces = written(pieces.withColumn("spread", F.monotonically_increasing_id()), "pieces")
    return slices(written(assembled(pieces, window), "sequences"))
