"""Huffman codes against the best possible, and exact round trips through files."""

import heapq

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventflow.llm import huffman, id_files
from eventflow.llm.common import new_path

from .samples import AWKWARD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def huffman_cost(counts):
    """Bits of the best code without a limit."""
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40))
def test_best_lengths(counts):
    lengths = huffman.code_lengths(np.array(counts), 30).astype(int)
    used = [n for n, c in zip(lengths, counts) if c]
    assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts))
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1
        assert sum(n * c for n, c in zip(lengths, counts)) == huffman_cost(counts)


def test_limit_holds_and_is_best():
    counts = np.array([2**i for i in range(12)])
    best = {}

    def search(i, room, most):
        """Least cost of giving ids from i on lengths up to ``most`` with Kraft sum ``room``."""
        if i == len(counts):
            return 0 if room >= 0 else None
        if (i, room) not in best:
            costs = [
                (n * int(counts[i]) + rest)
                for n in range(1, most + 1)
                if room >= 2 ** (most - n) and (rest := search(i + 1, room - 2 ** (most - n), most)) is not None
            ]
            best[i, room] = min(costs, default=None)
        return best[i, room]

    for most in (4, 5, 7):
        best.clear()
        lengths = huffman.code_lengths(counts, most)
        assert lengths.max() <= most
        assert (lengths * counts).sum() == search(0, 2**most, most)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), min_size=1, max_size=300), min_size=1, max_size=6))
def test_blocks_round_trip(documents):
    ids, sizes = np.concatenate(documents).astype(np.int64), np.array([len(d) for d in documents])
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=401)))
    bits, n_bytes, checkpoints = code.encode(ids, sizes)
    per_document, counts = huffman.stretches(sizes)
    base = 8 * (np.cumsum(n_bytes) - n_bytes)
    assert code.decode(bits, checkpoints + np.repeat(base, per_document), counts).tolist() == ids.tolist()
    # Any stretch decodes by itself.
    for at, n, want in zip(checkpoints + np.repeat(base, per_document), counts, range(len(counts))):
        alone = code.decode(bits, np.array([at]), np.array([n]))
        starts = np.cumsum(counts) - counts
        assert alone.tolist() == ids[starts[want] : starts[want] + n].tolist()


def written_and_read(spark, rows):
    path = new_path(spark, "id-files")
    id_files.write_ids(docs(spark, rows), PATH, 50_257, path)
    return path, id_files.read_ids(spark, path).orderBy("start").collect()


def test_files_round_trip(spark):
    path, got = written_and_read(spark, AWKWARD)
    tokenizer = Tokenizer.from_file(PATH)
    at = 0
    for row in got:
        assert row.start == at and row.n_tokens == len(row.ids) // 4
        at += row.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    want = [(i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in AWKWARD]
    assert sorted(((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got), key=repr) == sorted(want, key=repr)
    assert set(spark.read.parquet(f"{path}/blocks").columns) == {"start", "doc_ids", "doc_tokens", "bits", "checkpoints"}


def test_many_ranges_and_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(id_files, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(id_files, "BLOCK_IDS", 500)
    table = spark.read.parquet(f"{data}/documents.parquet")
    path = new_path(spark, "id-files")
    id_files.write_ids(table, PATH, 50_257, path)
    got = id_files.read_ids(spark, path).orderBy("start").collect()
    tokenizer, at = Tokenizer.from_file(PATH), 0
    rows = table.orderBy("doc_id").collect()
    assert spark.read.parquet(f"{path}/blocks").count() > 50
    assert len(got) == len(rows)
    for row, want in zip(got, rows):
        ids = [*tokenizer.encode(want.text, add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens) == (want.doc_id, at, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        at += len(ids)


def test_empty_table(spark):
    assert written_and_read(spark, [])[1] == []
    assert [r.n_tokens for r in written_and_read(spark, [(1, None)])[1]] == [1]
