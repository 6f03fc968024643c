"""Files of token ids under one canonical Huffman code.

The ids of all documents form one sequence in ascending order of doc_id. A file is a
Parquet file whose rows are blocks of whole documents; each block decodes by itself:

    start        long     ids of all documents before the block
    doc_ids      long[]   the documents of the block, in order
    doc_tokens   int[]    ids of each, with the end id
    bits         binary   the codes, first bit highest, each document padded to whole bytes
    checkpoints  binary   bit offset in ``bits`` of every 128th id of each document, little-endian 64-bit

The code follows from one byte per id, its code length, in the folder ``code`` beside
the blocks. Lengths come from the counts of all ids of all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventflow.llm.common import text_of, worker_store, written
from eventflow.llm.huffman import Code, code_lengths, stretches
from eventflow.llm.pieces import encoder

#: Ids after which a block ends with its document.
BLOCK_IDS = 1 << 17
#: Bytes of ids per range, and the most ranges.
RANGE_BYTES = 16 << 20
MOST_RANGES = 10_000
#: Ids coded at once.
SLICE_IDS = 1 << 19
BLOCKS = "start long, doc_ids array<long>, doc_tokens array<int>, bits binary, checkpoints binary"


def code_of(lengths: bytes) -> Code:
    """The worker's coder for the given code lengths."""
    store = worker_store("huffman-codes")
    key = hashlib.sha256(lengths).digest()
    if key not in store:
        store.clear()
        store[key] = Code(np.frombuffer(lengths, np.uint8))
    return store[key]


def tokenized(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, end id included; each task adds a row with its counts by id.

    The ids of a document are held as all their low bytes, then all their high bytes,
    and so on, which compresses better. ``counts`` is null but in the tasks' own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        names, counts = ["doc_id", "n_tokens", "ids", "counts"], np.zeros(vocabulary, np.int64)
        for batch in batches:
            data = [x + end for x in encode(batch.column(1).to_pylist())]
            counts += np.bincount(np.frombuffer(b"".join(data), encode.dtype), minlength=vocabulary)
            ids = [np.frombuffer(x, np.uint8).reshape(-1, encode.dtype.itemsize) for x in data]
            planes = pa.array([x.T.tobytes() for x in ids], pa.binary())
            lengths = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, planes, pa.nulls(len(ids), pa.binary())], names)
        if counts.any():
            none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, counts binary"
    )


def _ids(planes: bytes, n: int) -> np.ndarray:
    width = len(planes) // n
    raw = np.frombuffer(planes, np.uint8).reshape(width, n).T.tobytes()
    return np.frombuffer(raw, "<u4" if width == 4 else "<u2")


def _pairs(sums: np.ndarray) -> pa.RecordBatch:
    seen = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], ["what", "n"])


def write_ids(
    docs: DataFrame, tokenizer: str, vocabulary: int, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Writes the ids of all documents to ``path``, a new folder on storage all executors share.

    Null and empty texts hold the end id alone. Null ids come first; repeated rows are
    documents of their own, in any order among each other. An empty table writes no block.
    """
    spark = docs.sparkSession
    made = written(tokenized(docs, tokenizer, vocabulary, end_id, id_col, text_col), "ids")
    ids = made.where(F.col("counts").isNull()).drop("counts")
    n_ids = ids.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    ranges = int(min(MOST_RANGES, n_ids * 4 // RANGE_BYTES + 1))
    fractions = [i / ranges for i in range(1, ranges)]
    cuts = ids.agg(F.percentile_approx("doc_id", fractions, 10 * ranges).alias("cuts")).first()["cuts"] if fractions else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def range_of(keys: pa.Array) -> np.ndarray:
        """0 for null ids, else 1 and up by the cuts."""
        filled = keys.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, 1 + np.searchsorted(cuts, filled, side="right"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of the tasks' counts, as rows of what occurs."""
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts += np.frombuffer(data, "<i8")
        yield _pairs(counts)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids by range."""
        totals = np.zeros(len(cuts) + 2, np.int64)
        for batch in batches:
            np.add.at(totals, range_of(batch.column(0)), batch.column(1).to_numpy())
        yield _pairs(totals)

    # As many rows as the vocabulary, and the ranges, have members.
    counts, totals = np.zeros(vocabulary, np.int64), np.zeros(len(cuts) + 2, np.int64)
    for sums, rows, run in (
        (counts, made.where(F.col("counts").isNotNull()).select("counts"), added),
        (totals, ids.select("doc_id", "n_tokens"), ranged),
    ):
        for row in rows.mapInArrow(run, "what long, n long").groupBy("what").agg(F.sum("n").alias("n")).collect():
            sums[row["what"]] = row["n"]
    first = np.cumsum(totals) - totals
    lengths = code_lengths(counts).tobytes()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's bits and checkpoints."""
        code = code_of(lengths)
        for batch in batches:
            ranged, sizes = range_of(batch.column(0)), batch.column(1).to_numpy()
            piece = np.cumsum(sizes) // SLICE_IDS
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1):
                if not len(part):
                    continue
                n = sizes[part]
                ids = np.concatenate([_ids(x, k) for x, k in zip(batch.column(2).take(pa.array(part)).to_pylist(), n.tolist())])
                bits, n_bytes, checkpoints = code.encode(ids, n)
                values = [bits, checkpoints.astype("<u8").tobytes()]
                ends = [np.cumsum(n_bytes), 8 * np.cumsum(stretches(n)[0])]
                cut = [[v[i:j] for i, j in zip(np.r_[0, e[:-1]], e)] for v, e in zip(values, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranged[part]), batch.column(0).take(pa.array(part)), pa.array(n), *(pa.array(c, pa.binary()) for c in cut)],
                    ["range", "doc_id", "n_tokens", "bits", "checkpoints"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins documents, sorted by range and id, to blocks."""
        held, size, part, at = [], 0, None, 0

        def block() -> pa.RecordBatch:
            keys, sizes, bits, checkpoints = zip(*held)
            lengths = np.array([len(b) for b in bits])
            base = np.repeat(8 * (np.cumsum(lengths) - lengths), [len(c) // 8 for c in checkpoints])
            moved = (np.frombuffer(b"".join(checkpoints), "<u8").astype(np.int64) + base).astype("<u8").tobytes()
            values = ([at - size], [keys], [sizes], [b"".join(bits)], [moved])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            names = ["start", "doc_ids", "doc_tokens", "bits", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for ranged, key, n, data, checks in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if held and (ranged != part or size >= BLOCK_IDS):
                    yield block()
                    held, size = [], 0
                if ranged != part:
                    part, at = ranged, int(first[ranged])
                held.append((key, n, data, checks))
                size += n
                at += n
        if held:
            yield block()

    sorted_ids = ids.mapInArrow(coded, "range long, doc_id long, n_tokens long, bits binary, checkpoints binary")
    sorted_ids = sorted_ids.repartition("range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first())
    sorted_ids.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files in ``path``: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = code_of(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_tokens"], np.int64)
                ids = code.decode(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), stretches(sizes)[1])
                ends = np.cumsum(sizes)
                data = ids.astype("<u4").tobytes()
                texts = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                longs = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays([*longs, pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return files.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")
