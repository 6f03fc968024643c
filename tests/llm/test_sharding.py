"""Shards: near equal bytes, gapless slots, equal texts together, hot texts split."""

import zlib
from collections import Counter, defaultdict

from eventflow.llm.sharding import shards

from .samples import AWKWARD, docs


def check(table, rows, count):
    got = shards(table, count).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < count
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, sizes


def test_awkward_rows(spark):
    check(docs(spark, AWKWARD), AWKWARD, 4)
    check(docs(spark, AWKWARD), AWKWARD, 1)


def test_empty_table(spark):
    assert shards(docs(spark, []), 16).count() == 0


def test_near_equal_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(6000)]
    got, sizes = check(docs(spark, rows), rows, 8)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    of_text = defaultdict(set)
    for r in got:
        of_text[r.text_crc32].add(r.shard)
    # Copies lie in one shard, or in neighbours.
    assert all(max(s) - min(s) == len(s) - 1 for s in of_text.values())
    assert len(of_text[zlib.crc32(("hot text " * 20).encode())]) > 1


def test_repeats_of_one_row_are_divided(spark):
    rows = [(1, "same")] * 400 + [(i, "same") for i in range(400)]
    check(docs(spark, rows), rows, 4)
    # Half of the bytes are repeats of one row, which alone would fill half of the shards.
    rows = [(7, "a row that comes again and again")] * 20_000 + [(i, f"row {i} has a text of its own {i % 7}") for i in range(20_000)]
    got, sizes = check(docs(spark, rows), rows, 16)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean


def test_plan_has_no_python(spark, data):
    plan = shards(spark.read.parquet(f"{data}/documents.parquet"), 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
