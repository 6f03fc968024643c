"""Merkle manifest: roots, proofs and tampering against a direct computation, over one and many tiers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventflow.llm import merkle

from .samples import AWKWARD

FIELDS = ["doc_id", "lang", "text"]
SCHEMA = "doc_id long, lang string, text string, digest string, grp int, `row` int, n string, level int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(i, lang, t, "d", 1, 2, "n", 3) for i, lang, t in rows], SCHEMA)


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 8])
        i //= 8


def expected(rows, changed):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[1], []).append(row)
    trees = {}
    for lang, own in by_lang.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in own])
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    whole = tree([trees[k][-1][0] for k in order])
    out = []
    for at, lang in enumerate(order):
        for i, row in enumerate(by_lang[lang]):
            walk = [*siblings(trees[lang], i), *siblings(whole, at)]
            digest = leaf(changed(row))
            for a, b in walk:
                digest = sha(a + digest + b)
            root = whole[-1][0]
            out.append((row[0], leaf(row), trees[lang][-1][0], root, sha("".join(a + b for a, b in walk)), digest, digest == root))
    return sorted(out, key=repr)


def tampered(row):
    return (row[0], row[1], row[2].replace("T", "t")) if row[2] and row[0] is not None and row[0] % 3 == 0 else row


def audited(spark, rows):
    found = merkle.digest_of([F.regexp_replace(c, "T", "t") if c == "text" else F.col(c) for c in FIELDS])
    leaves = merkle.leaves(table(spark, rows), FIELDS, "doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, found))
    manifest = merkle.build(leaves)
    return manifest, sorted((tuple(r) for r in merkle.audit(manifest).collect()), key=repr)


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["en", "en", "en", "de", None, "", "zé"]), f"Text {i} " * rng.randrange(3)) for i in rng.sample(range(2 * n), n)]


def test_awkward_rows(spark):
    rows = [(i, ("en", None, "")[k % 3], t) for k, (i, t) in enumerate(AWKWARD)] + [(7, "x", "T")] * 9
    assert audited(spark, rows)[1] == expected(rows, tampered)


def test_empty_table_and_one_row(spark):
    assert audited(spark, [])[1] == []
    manifest, got = audited(spark, [(3, "en", "a T")])
    assert got == expected([(3, "en", "a T")], tampered) and not got[0][-1]
    assert manifest.log().count() == 2


def test_many_rows(spark):
    rows = rows_of(1500, 1)
    got = audited(spark, rows)[1]
    assert got == expected(rows, tampered)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [9, 700])
def test_several_tiers(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "de" if i % 50 == 0 else "en", f"T{i}") for i in range(n)] + [(1, f"g{i}", "T") for i in range(10)]
    manifest, got = audited(spark, rows)
    assert got == expected(rows, tampered)
    # Each tree's log has every position once, and a node comes after all of its children.
    log = manifest.log().collect()
    for group in {r.grp for r in log}:
        own = sorted((r.position, r.level) for r in log if r.grp == group)
        assert [p for p, _ in own] == list(range(len(own)))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 512, 1000, 4096])
def test_positions_are_those_of_completion(n):
    top = merkle.height(n)
    log = merkle.append_nodes([sha(str(i)) for i in range(n)], top)
    seen = {}
    for at, (level, _) in enumerate(log):
        index = seen.get(level, 0)
        assert merkle.position(level, index, n, top) == at
        seen[level] = index + 1
    assert log[-1][1] == tree([sha(str(i)) for i in range(n)])[-1][0]
