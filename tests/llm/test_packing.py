"""Best-fit decreasing against a plain search, and the packed result as a whole."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventflow.llm import packing
from eventflow.llm.common import written

from .samples import AWKWARD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, capacity):
    space, window, offset = [], [], []
    for size in lengths:
        fitting = [w for w in range(len(space)) if space[w] >= size]
        if not fitting:
            space.append(capacity)
            fitting = [len(space) - 1]
        w = min(fitting, key=lambda w: space[w])
        window.append(w)
        offset.append(capacity - space[w])
        space[w] -= size
    return window, offset, space


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_tightest_window(capacity, data):
    lengths = sorted(data.draw(st.lists(st.integers(1, capacity), max_size=60)), reverse=True)
    window, offset = packing.best_fit(np.array(lengths, np.int64), capacity)
    want_window, want_offset, space = plain_best_fit(lengths, capacity)
    # Ties between equally tight windows are free: what is left in each, sorted, is the same.
    left = defaultdict(lambda: capacity)
    for w, n in zip(window.tolist(), lengths):
        left[w] -= n
    assert sorted(left.values()) == sorted(space[w] for w in set(want_window))
    fill = defaultdict(int)
    for w, o, n in zip(window.tolist(), offset.tolist(), lengths):
        assert o == fill[w]
        fill[w] += n
    assert max(fill.values(), default=0) <= capacity


def check(packed, rows, window, end=(1,)):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, *end]) for i, t in rows]
    want = sorted(
        ((i, s, len(x[s : s + window]), len(x), zlib.crc32(np.array(x[s : s + window], "<u4").tobytes())) for i, x in ids for s in range(0, len(x), window)),
        key=repr,
    )
    got = sorted(((r.doc_id, r.start, r.length, r.doc_tokens, zlib.crc32(r.ids)) for r in packed), key=repr)
    assert got == want
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_every_id_in_one_piece(spark):
    pieces = packing.cut(docs(spark, AWKWARD), PATH, window=64)
    check(packing.place(pieces, 64).collect(), AWKWARD, 64)
    check(packing.place(pieces, 64, group_rows=50).collect(), AWKWARD, 64)


def test_large_ids_beside_nulls(spark):
    rows = [(2**62 + 1, "a"), (None, "b"), (2**62 + 3, None)]
    check(packing.place(packing.cut(docs(spark, rows), PATH, 8), 8).collect(), rows, 8)


def test_empty_table_and_no_end(spark):
    assert packing.place(packing.cut(docs(spark, []), PATH)).count() == 0
    assert packing.cut(docs(spark, [(1, None), (2, "")]), PATH, end_id=None).count() == 0


def test_sequences_hold_the_ids(spark):
    packed = packing.place(packing.cut(docs(spark, AWKWARD), PATH, 64), 64)
    n = {r.sequence_id: r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    for row in packing.sequences(packed, 64, pad_id=7).collect():
        ids = np.frombuffer(row.ids, "<u4")
        power = row.n_tokens & (row.n_tokens - 1) == 0
        assert row.n_tokens == n[row.sequence_id] and len(ids) == (row.n_tokens if power else 64)
        assert (ids[row.n_tokens :] == 7).all()


def test_little_padding(spark, data):
    packed = packing.place(packing.cut(spark.read.parquet(f"{data}/documents.parquet"), PATH))
    total, sequences = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert total / (2048 * sequences) > 0.98


def test_query_slices_written_sequences(spark, monkeypatch):
    """The digests come from padded sequences that were written with all ids."""
    made = []

    def kept(df, name):
        made.append((name, written(df, name)))
        return made[-1][1]

    monkeypatch.setattr(packing, "written", kept)
    rows = packing.packed(docs(spark, AWKWARD), PATH, 64).collect()
    whole = {r.sequence_id: r for r in dict(made)["sequences"].collect()}
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in AWKWARD]
    want = sorted(((i, s, len(x[s : s + 64]), len(x), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes())) for i, x in ids for s in range(0, len(x), 64)), key=repr)
    assert sorted(((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in rows), key=repr) == want
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        assert zlib.crc32(whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
    assert at == {k: r.n_tokens for k, r in whole.items()}
    for r in whole.values():
        n = r.n_tokens
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 64) and not any(r.ids[4 * n :])
    assert packing.packed(docs(spark, []), PATH, 64).count() == 0


def test_repeats_of_one_row_go_to_many_groups(spark):
    rows = [(None, "the same row again and again")] * 100_000
    pieces = packing.cut(docs(spark, rows), PATH, 64, short=True).withColumn("spread", F.monotonically_increasing_id())
    whole = packing.assembled(pieces, 64, group_rows=5_000)
    groups = whole.groupBy(F.shiftright("sequence_id", packing.GROUP_BITS)).agg(F.sum(F.size("pieces")).alias("n")).collect()
    assert len(groups) == 20 and sum(r.n for r in groups) == 100_000 and max(r.n for r in groups) < 6_000
