"""Edit distance, recall and results against brute force."""

import inspect

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventflow.llm import decontaminate as D

from .samples import AWKWARD, docs


def plain_fit(item, region):
    """Least edit distance of ``item`` to any stretch of ``region``."""
    row = [0] * (len(region) + 1)
    for symbol in item:
        new = [row[0] + 1]
        for j, other in enumerate(region):
            new.append(min(row[j] + (symbol != other), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_fit(item, region):
    distance, start, end = D.fit(np.array(item), np.array(region, np.int64))
    assert distance == plain_fit(item, region)
    assert plain_fit(item, region[start:end]) == distance


ITEMS = [(i, " ".join(f"item{i}word{k % 9}{k * k % 7}" for k in range(5 + 4 * i))) for i in range(12)]


def test_recall_at_the_allowed_distance():
    block, random = D.item_block(ITEMS, 0.8, 0.98), np.random.default_rng(1)
    names = {n: w for w, n in block["vocabulary"].items()}
    found = 0
    for trial in range(200):
        item = trial % len(ITEMS)
        copy = D.edited(block["codes"][item], block["limits"][item], len(names) + 1, random)
        text = "before it some other words " + " ".join(names.get(int(c), "foreign") for c in copy) + " and after it more"
        found += any(m[1] == item for m in D.matches([text], block))
    assert found >= 190


def test_default_target_is_reached_in_every_size_class(spark):
    """With the production defaults, copies at the allowed distance are found as often as the target says."""
    block, random = next(D.blocks(items(spark, ITEMS), 0.8, TARGET, "item_id", "text")), np.random.default_rng(7)
    names = {n: w for w, n in block["vocabulary"].items()}
    for item, code in enumerate(block["codes"]):
        texts = []
        for _ in range(100):
            copy = D.edited(code, block["limits"][item], len(names) + 1, random)
            texts.append("some words " + " ".join(names.get(int(c), "foreign") for c in copy) + " and more")
        assert len({m[0] for m in D.matches(texts, block) if m[1] == item}) >= 95


TARGET = 0.98


def test_target_of_the_operators():
    for operator in (D.find_leaks, D.without_leaks):
        assert inspect.signature(operator).parameters["target"].default == TARGET


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_classes_short_of_the_target_are_searched_exactly(monkeypatch, similarity):
    monkeypatch.setattr(D, "MOST_HASHES", 1)
    monkeypatch.setattr(D, "WALKS", 1)
    monkeypatch.setattr(D, "WINDOWS", 50)
    block, random = D.item_block(ITEMS, similarity, 0.98), np.random.default_rng(5)
    names = {n: w for w, n in block["vocabulary"].items()}
    assert any(not t["hashes"] for t in block["classes"])
    texts = []
    for trial in range(120):
        item = trial % len(ITEMS)
        copy = D.edited(block["codes"][item], block["limits"][item], len(names) + 1, random)
        texts.append("before it words " * (trial % 5) + " ".join(names.get(int(c), "foreign") for c in copy) + " after" * (trial % 3))
    found = {(m[0], m[1]): m[2] for m in D.matches(texts, block)}
    exact = {i for i, c in enumerate(block["codes"]) if any(not t["hashes"] and i in t["members"] for t in block["classes"])}
    for t, text in enumerate(texts):
        code = D.codes_of(text, block["vocabulary"]).tolist()
        for i in exact:
            distance = plain_fit(block["codes"][i].tolist(), code)
            assert found.get((t, i)) == (distance if distance <= block["limits"][i] else None)


def test_blocks_agree_with_brute_force():
    random, block = np.random.default_rng(2), D.item_block(ITEMS, 0.8, 0.98)
    texts = []
    for _ in range(60):
        words = [f"other{x}" for x in random.integers(0, 50, 40)]
        item = ITEMS[int(random.integers(len(ITEMS)))][1].split()
        for _ in range(int(random.integers(0, 10))):
            item[int(random.integers(len(item)))] = "changed"
        at = int(random.integers(len(words)))
        texts.append(" ".join(words[:at] + item + words[at:]))
    got = {(m[0], m[1]) for m in D.matches(texts, block)}
    want = set()
    for t, text in enumerate(texts):
        codes = D.codes_of(text, block["vocabulary"]).tolist()
        want |= {(t, i) for i, item in enumerate(block["codes"]) if plain_fit(item.tolist(), codes) <= block["limits"][i]}
    assert got <= want and len(got) >= 0.95 * len(want) > 0


@pytest.mark.parametrize("similarity", [0.8, 0.5, 1.0])
def test_short_items_stand_anywhere(similarity):
    """Items of one to sixty words over few words, so that runs begin alike, end inside each other and repeat."""
    random = np.random.default_rng(11)
    items = [(i, " ".join(f"w{x}" for x in random.integers(0, 6, size))) for i, size in enumerate([*range(1, 9), *range(1, 9), 20, 60])]
    block = D.item_block([*items, (90, ""), (91, items[2][1])], similarity, 0.98)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 9, size)) for size in [*range(30), 200]]
    texts += [text for _, text in items] + [f"before {text} after {text}" for _, text in items]
    found = {(m[0], m[1]): m[2:] for m in D.matches(texts, block)}
    assert not {item for _, item in found if not len(block["codes"][item])}
    for t, text in enumerate(texts):
        code = D.codes_of(text, block["vocabulary"]).tolist()
        for i, item in enumerate(block["codes"]):
            if not len(item) or (block["limits"][i] and len(item) > len(code)):
                continue
            if block["limits"][i] == 0:
                places = [k for k in range(len(code) - len(item) + 1) if code[k : k + len(item)] == item.tolist()]
                assert found.get((t, i)) == ((0, places[0], places[0] + len(item)) if places else None)
            elif (t, i) in found:
                assert found[t, i][0] == plain_fit(item.tolist(), code) <= block["limits"][i]


def test_blocks_are_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    bench = items(spark, [*ITEMS, (50, "Just three words")])
    sizes = [len(b["ids"]) for b in D.blocks(bench, 0.8, 0.98, None, "text")]
    assert sum(sizes) == len(ITEMS) + 1 and len(sizes) > 3
    named = bench.select(D.F.col("text").alias("item"))
    kept = D.without_leaks(docs(spark, LEAKED), named, item_text_col="item")
    assert sorted(r.doc_id for r in kept.collect()) == [8]


LEAKED = [
    (1, "some words " + ITEMS[3][1] + " more words"),
    (2, "some words " + ITEMS[3][1].upper().replace(" ", ",\n") + "!"),
    (3, ITEMS[5][1]),
    (3, ITEMS[5][1]),
    (None, ITEMS[0][1] + " " + ITEMS[1][1]),
    (5, "just three words"),
    (6, "here just three words among others"),
    (7, ITEMS[9][1].rsplit(" ", 6)[0]),
    (8, ITEMS[9][1].split(" ", 20)[-1]),
]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [20_000, 5])
def test_leaks_of_a_table(spark, monkeypatch, block):
    monkeypatch.setattr(D, "ITEM_BLOCK", block)
    bench = items(spark, [*ITEMS, (50, "Just three words"), (51, None), (52, "!?"), (None, "an item without an id")])
    table = docs(spark, [*AWKWARD, *LEAKED])
    rows = D.find_leaks(table, bench).collect()
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in rows), key=repr)
    want = [(1, 3, 0), (2, 3, 0), (3, 5, 0), (3, 5, 0), (5, 50, 0), (6, 50, 0), (7, 9, 6), (None, 0, 0), (None, 1, 0)]
    assert got == sorted(want, key=repr)
    spans = {(r.doc_id, r.item_id): (r.first_word, r.end_word) for r in rows}
    assert spans[1, 3] == (2, 19) and spans[None, 1] == (5, 14) and spans[6, 50] == (1, 4)
    kept = D.without_leaks(table, bench)
    assert kept.schema == table.schema
    leaking = {1, 2, 3, 5, 6, 7}
    clean = [x for x in [*AWKWARD, *LEAKED] if x not in LEAKED or (x[0] is not None and x[0] not in leaking)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_empty_tables(spark):
    bench = items(spark, ITEMS)
    assert D.find_leaks(docs(spark, []), bench).count() == 0
    assert D.find_leaks(docs(spark, LEAKED), items(spark, [])).count() == 0
    assert D.without_leaks(docs(spark, LEAKED), items(spark, [])).count() == len(LEAKED)


def test_query_finds_every_verbatim_item(spark, data):
    from eventflow.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, data).collect()}
    bench = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert {(d.doc_id, b.item_id) for d in rows for b in bench if b.text in (d.text or "")} <= got
    words = {d.doc_id: D.WORD.findall((d.text or "").lower()) for d in rows}
    for doc, item in got:
        target = D.WORD.findall(next(b.text for b in bench if b.item_id == item).lower())
        assert plain_fit(target, words[doc]) <= D.allowed(len(target), 0.8)
