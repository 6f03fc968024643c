"""The digest index over several batches, against a plain dictionary."""

import hashlib
import re

from eventflow.llm.common import new_path
from eventflow.llm.exact_dedup import DigestIndex, decide, deduplicated

from .samples import AWKWARD, docs


def digest(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).digest()


def index(spark):
    return DigestIndex(spark, new_path(spark, "digest-index"), buckets=4)


def order(i):
    return (i is None, i or 0)


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        same = groups[digest(t)]
        keep = min(same, key=order)
        kept = i == keep and (digest(t), i) not in seen
        seen.add((digest(t), i))
        out.append((i, digest(t), keep, len(same), kept))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    got = decide(docs(spark, AWKWARD), index(spark), "a")
    assert got.columns == ["doc_id", "digest", "keep_id", "group_size", "kept"]
    assert rows_of(got) == plain(AWKWARD)


def test_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    assert rows_of(decide(docs(spark, rows), index(spark), "a")) == plain(rows)


def test_later_batches_and_repeats(spark):
    store = index(spark)
    first, second = [(5, "a"), (6, "b"), (7, "a")], [(1, "a"), (2, "c"), (3, "c"), (4, None)]
    decide(docs(spark, first), store, "first")
    for _ in range(2):  # repeating a batch changes nothing
        got = {r.doc_id: (r.keep_id, r.kept) for r in decide(docs(spark, second), store, "second").collect()}
        assert got == {1: (5, False), 2: (2, True), 3: (2, False), 4: (4, True)}
        assert store.entries().count() == 4
    again = DigestIndex(spark, store.path, buckets=4)
    assert {bytes(r.digest) for r in again.entries().collect()} == {digest(t) for t in ("a", "b", "c", None)}


def test_index_is_bucketed_and_not_shuffled(spark):
    store = index(spark)
    decide(docs(spark, [(1, "a"), (2, "b")]), store, "first")
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {store.name}").collect()}
    assert described["Num Buckets"] == "4" and described["Sort Columns"] == "[`digest`]"


def test_rows_that_stay(spark):
    table = docs(spark, AWKWARD)
    kept = deduplicated(table, index(spark), "a")
    assert kept.schema == table.schema
    want = sorted(((i, t) for (i, t), r in zip(AWKWARD, _marks(AWKWARD)) if r), key=repr)
    assert sorted(((digest(r.text), r.doc_id) for r in kept.collect()), key=repr) == sorted(((digest(t), i) for i, t in want), key=repr)
    assert deduplicated(docs(spark, []), index(spark), "a").count() == 0


def _marks(rows):
    """Whether each row stays, in order."""
    keep, seen = {}, set()
    for i, t in rows:
        keep[digest(t)] = min(keep.get(digest(t), i), i, key=order)
    for i, t in rows:
        yield i == keep[digest(t)] and (digest(t), i) not in seen
        seen.add((digest(t), i))
