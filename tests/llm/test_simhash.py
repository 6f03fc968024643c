"""Fingerprints, search and components against brute force."""

import inspect
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from eventflow.llm import simhash
from eventflow.llm.components import components
from eventflow.llm.vptree import VantageTree

from .samples import AWKWARD, docs


def plain_fingerprint(text, words=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, linked):
    label = list(range(len(values)))
    while True:
        new = [min(label[j] for j in range(len(values)) if i == j or linked(values[i], values[j])) for i in range(len(values))]
        if new == label:
            return label
        label = new


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAÄ \n\t\x1c\x85", max_size=60), st.integers(1, 5))
def test_fingerprint(text, words):
    assert simhash.fingerprint_of(simhash.shingle_hashes(text, words)) == plain_fingerprint(text, words)


def test_fingerprint_of_long_text(monkeypatch):
    text = " ".join(f"w{i % 97} x{i % 31}" for i in range(3000))
    monkeypatch.setattr(simhash, "SHINGLES", 100)
    assert simhash.fingerprint_of(simhash.shingle_hashes(text, 4)) == plain_fingerprint(text)


@pytest.mark.parametrize("leaf_values", [1, 8, 256])
@pytest.mark.parametrize("radius", [0, 1, 2])
def test_near_values_meet_in_a_leaf(leaf_values, radius):
    bits = 10
    tree = VantageTree(bits, leaf_values, radius)
    assert np.bincount(tree.leaf).sum() == 1 << bits
    visits = [set(tree.visited[tree.first[v] : tree.first[v + 1]].tolist()) for v in range(1 << bits)]
    for v in range(1 << bits):
        near = [w for w in range(1 << bits) if bin(v ^ w).count("1") <= radius]
        assert all(tree.leaf[w] in visits[v] or tree.leaf[v] in visits[w] for w in near)
    if leaf_values == 8:  # the search is pruned
        assert np.mean([len(v) for v in visits]) < (1 + tree.leaves) / 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 3)), max_size=40))
def test_forest_connects_and_has_no_cycle(edges):
    a, b, d = (np.array([e[i] for e in edges], np.int64) for i in range(3))
    kept = simhash.forest(a, b, d)
    every = plain_components(list(range(13)), lambda x, y: any({x, y} == {p, q} for p, q, _ in edges))
    some = plain_components(list(range(13)), lambda x, y: any({x, y} == {edges[k][0], edges[k][1]} for k in kept))
    assert every == some
    assert len(kept) == 13 - len(set(every))


def clustered(n, most, seed):
    random = np.random.default_rng(seed)
    values = random.integers(0, 1 << 64, n, np.uint64, endpoint=False)
    for i in range(n // 2):  # copies of copies with a few bits changed
        value = int(values[random.integers(i + 1)])
        for bit in random.permutation(64)[: random.integers(0, most + 2)]:
            value ^= 1 << int(bit)
        values[n // 2 + i] = value
    return values


@pytest.mark.parametrize("most", [3, 4, 7, 11])
@pytest.mark.parametrize("small", [False, True])
def test_links_connect_all_pairs(spark, monkeypatch, most, small):
    if small:
        for name, value in (("LEAF_VALUES", 4096), ("PART_ROWS", 16), ("BUFFER_ROWS", 300), ("PAIRS", 1000)):
            monkeypatch.setattr(simhash, name, value)
    values = np.unique(clustered(600, most, most))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = simhash.links(table, most).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") == r.distance <= most for r in found)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= most
    label = np.arange(len(values))
    while not np.array_equal(label, new := np.array([label[row].min() for row in near])):
        label = new
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    mine = list(range(len(values)))
    for _ in range(len(values)):
        before = list(mine)
        for r in found:
            i, j = place[r.a], place[r.b]
            mine[i] = mine[j] = min(mine[i], mine[j])
        if before == mine:
            break
    assert mine == label.tolist()


def test_components(spark):
    random = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == {n: r for n, r in label.items() if n != r}


def test_near_duplicates_of_awkward_rows(spark):
    rows = [*AWKWARD, (20, "a b c d e f g h"), (21, "A b C d e f G h"), (22, "a\tb\nc d e f g h"), (None, "a b c d e f g h")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    values = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(values, lambda x, y: bin(x ^ y).count("1") <= 4)
    least = {}
    for (i, _), root in zip(rows, label):
        least[root] = i if least.get(root) is None else min(least[root], i if i is not None else least[root])
    want = Counter((i, v, least[root]) for (i, _), v, root in zip(rows, values, label))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def shingle_set(text, words=5):
    return set(simhash.shingle_hashes(text, words).tolist())


def test_one_of_each_group_stays(spark):
    random = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in random.integers(0, 5000, 600)) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        for c in range(8):
            words = text.split()
            for _ in range(c % 3):
                words[int(random.integers(len(words)))] = "changed"
            rows.append((len(rows) * 7 % 96, " ".join(words)))
    rows += [(200, "lone text"), (201, None), (202, ""), (None, base[0]), (None, "x y z"), (300, "p q r"), (300, "p q r")]
    table = docs(spark, rows)
    kept = simhash.one_of_each(table)
    assert kept.schema == table.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    for text in base:  # of each group the smallest id
        group = [(i, t) for i, t in rows if t and len(shingle_set(t) & shingle_set(text)) / len(shingle_set(t) | shingle_set(text)) >= 0.8]
        stay = [x for x in group if x in got]
        assert stay == [min((x for x in group if x[0] is not None), key=lambda x: x[0])]
    assert got[200, "lone text"] == got[None, "x y z"] == 1
    assert got[201, None] == 1 and got[202, ""] == 0  # null and empty are alike
    assert got[300, "p q r"] == 2  # repeats of one row stay together
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def similar_groups(seed):
    """Groups of independently edited copies, with similarities from 0.7 to 0.95."""
    random = np.random.default_rng(seed)
    rows = []
    for group in range(12):
        base = [f"g{group}w{x}" for x in random.integers(0, 5000, 300)]
        rows.append((len(rows), " ".join(base)))
        for copy in range(14):
            words = list(base)
            for _ in range(int(random.integers(2, 11))):
                words[int(random.integers(len(words)))] = f"new{random.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_near_pairs_against_brute_force(spark, monkeypatch, every, small):
    if small:
        for name, value in (("GROUP_ROWS", 16), ("BUFFER_ROWS", 50), ("PAIRS", 200), ("GROUP_LEAVES", 200)):
            monkeypatch.setattr(simhash, name, value)
    random = np.random.default_rng(6)
    values = clustered(300, 11, 5)
    values[:20] = values[20:40]  # different sets under one fingerprint
    size, root = random.integers(80, 130, 300), np.where(random.random(300) < 0.5, random.integers(0, 5, 300), np.arange(300) + 1000)
    rows = [(int(v), i, int(size[i]), int(root[i])) for i, v in enumerate(values.view(np.int64))]
    found = simhash.near_pairs(spark.createDataFrame(rows, "fp long, id long, size long, root long"), 15, 0.8, every).collect()
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 15
    near &= (np.minimum.outer(size, size) >= 0.8 * np.maximum.outer(size, size)) & (root[:, None] != root[None, :])
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b}
    got = {(r.a, r.b) for r in found}
    assert got <= want and len(found) == len(got)
    if every:
        assert got == want
    else:
        parts = [plain_components(list(range(300)), lambda x, y, e=e: (min(x, y), max(x, y)) in e) for e in (got, want)]
        assert parts[0] == parts[1]


def test_refused_links_hide_no_others(spark):
    rows = similar_groups(8)
    most = inspect.signature(simhash.one_of_each).parameters["most"].default
    sets = [shingle_set(t) for _, t in rows]
    prints = [fingerprint_in_pipeline(t) for _, t in rows]

    def linked(i, j):
        shared = len(sets[i] & sets[j])
        return bin(prints[i] ^ prints[j]).count("1") <= most and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared)

    label = plain_components(list(range(len(rows))), linked)
    got = sorted(r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect())
    assert got == sorted(set(label)) and 12 <= len(got) < len(rows)


def fingerprint_in_pipeline(text):
    return simhash.fingerprint_of(np.unique(simhash.shingle_hashes(text, 5)))


def test_repeats_and_distant_copies_are_found(spark):
    """A copy with a part repeated many times, and most pairs at the least similarity."""
    random = np.random.default_rng(12)
    rows = []
    for k in range(60):
        words = [f"p{k}w{x}" for x in random.integers(0, 5000, 300)]
        copy = list(words)
        for place in (np.arange(6) * 45 + random.integers(5, 30)).tolist():
            copy[place] = f"new{random.integers(1 << 30)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        assert 0.8 <= len(a & b) / len(a | b) <= 0.85
    line = " ".join(f"again{x}" for x in range(30))
    rows += [(1000, f"{rows[0][1].replace('p0', 'q')} {line}"), (1001, f"{rows[0][1].replace('p0', 'q')}{(' ' + line) * 60}")]
    kept = {r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert kept >= {2 * k for k in range(60)} and 1000 in kept and 1001 not in kept
    assert len(kept & {2 * k + 1 for k in range(60)}) <= 3


def test_memory_of_the_widest_tree(monkeypatch):
    """Each worker holds the tree of radius 3: ten million visits in a bounded space, the same for any data."""
    import tracemalloc

    from eventflow.llm import common, vptree

    monkeypatch.setattr(common.sys, "modules", {**common.sys.modules})
    common.sys.modules.pop("eventflow_worker_store", None)
    tracemalloc.start()
    tree, groups, first = simhash._grouped(3, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(tree, vptree.VantageTree) and len(tree.visited) == first[-1] > 9_000_000
    assert peak < 120 << 20


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 300))
def test_parities_never_tell_more_apart_than_there_is(both, left, right):
    random = np.random.default_rng([both, left, right])
    values = np.unique(random.integers(0, 1 << 64, both + left + right, np.uint64, endpoint=False))
    a, b = values[: both + left], np.r_[values[:both], values[both + left :]]
    found = [np.array([simhash.parities_of(np.unique(x))], object) for x in (a, b)]
    assert simhash._differing(*found)[0] <= len(np.setxor1d(a, b))


def test_no_table_holds_the_pairs_of_a_group(spark, monkeypatch):
    """Texts close by fingerprint and below the similarity, all pairs of them: the tables grow with the texts."""
    random = np.random.default_rng(31)
    base = [f"w{x}" for x in random.integers(0, 5000, 400)]
    rows = []
    for copy in range(160):
        words = list(base)
        for place in (np.arange(8) * 40 + random.integers(0, 34)).tolist():
            words[place] = f"new{random.integers(1 << 30)}"
        rows.append((copy, " ".join(words)))
    sets, prints = [shingle_set(t) for _, t in rows], np.array([fingerprint_in_pipeline(t) for _, t in rows], np.uint64)
    alike = [[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets]
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 15
    assert near.sum() > 100 * len(rows) and (near & np.array(alike)).sum() < 20 * len(rows)
    counts, plain = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda *a, **k: counts.append(plain(*a, **k).count()) or plain(*a, **k))
    kept = sorted(r.doc_id for r in simhash.one_of_each(docs(spark, rows)).collect())
    label = plain_components(list(range(len(rows))), lambda i, j: near[i, j] and alike[i][j])
    assert kept == sorted(set(label)) and max(counts) < 20 * len(rows)


@pytest.mark.parametrize("tile", [1, 700, 1 << 21])
def test_clusters_are_compared_whole(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)
    monkeypatch.setattr(simhash, "PAIRS", 500)
    random = np.random.default_rng(3)
    base = [np.unique(random.integers(0, 1 << 62, 100)) for _ in range(4)]
    rows = []
    for i in range(48):
        own = base[i % 4].copy()
        own[: random.integers(0, 16)] = random.integers(0, 1 << 62)
        own = np.unique(np.r_[own, random.integers(0, 1 << 62, random.integers(0, 5))])
        rows.append((int(random.integers(4)), i, len(own), i if i % 5 else 5, i % 4 if i % 4 < 2 else 2, own.tolist()))
    table = spark.createDataFrame(rows, "fp long, id long, size long, root long, cluster long, shingles array<long>")
    found = simhash.similar_pairs(table.drop("shingles"), table.select("id", "shingles"), 1, 0.8).collect()

    def linked(x, y):
        a, b = set(x[5]), set(y[5])
        return x[3] == y[3] or x[4] == y[4] and bin(x[0] ^ y[0]).count("1") <= 1 and len(a & b) >= 0.8 * len(a | b)

    want = plain_components(rows, linked)
    given = {(r.a, r.b) for r in found}
    assert all(linked(rows[a], rows[b]) and a < b for a, b in given)
    assert plain_components(rows, lambda x, y: x[3] == y[3] or (min(x[1], y[1]), max(x[1], y[1])) in given) == want


def alike(x, y, similarity=0.8):
    shared = len(x & y)
    return shared >= similarity * (len(x) + len(y) - shared)


def test_similar_texts_with_distant_fingerprints_are_found(spark):
    """The pipeline's stage, texts of any length: the similarity alone decides, not the fingerprints."""
    random = np.random.default_rng(17)
    rows, distant = [], Counter()
    for length, cut, least in ((9, 1, 12), (24, 2, 4), (300, 30, 2)):
        while distant[length] < least:
            words = [f"w{x}" for x in random.integers(0, 1 << 40, length)]
            copy = words[:-cut] + [f"w{x}" for x in random.integers(0, 1 << 40, cut if length > 9 else 0)]
            texts = " ".join(words), " ".join(copy)
            far = bin(fingerprint_in_pipeline(texts[0]) ^ fingerprint_in_pipeline(texts[1])).count("1") > 15
            if alike(*map(shingle_set, texts)) and far:
                distant[length] += 1
                rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    rows += [(1000 + i, f"some other text of few words {i}") for i in range(20)]
    sets = [shingle_set(t) for _, t in rows]
    label = plain_components(list(range(len(rows))), lambda i, j: alike(sets[i], sets[j]))
    got = sorted(r.doc_id for r in corpus_pipeline.dissimilar(spark, docs(spark, rows), "").collect())
    assert got == sorted({rows[k][0] for k in label}) and len(got) == len(rows) - 18


def test_refused_and_distant_links_hide_no_others(spark):
    rows = similar_groups(8)
    sets = [shingle_set(t) for _, t in rows]
    label = plain_components(list(range(len(rows))), lambda i, j: alike(sets[i], sets[j]))
    got = sorted(r.doc_id for r in corpus_pipeline.dissimilar(spark, docs(spark, rows), "").collect())
    assert got == sorted(set(label))


@pytest.mark.parametrize("common", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_similar_sets_meet(spark, monkeypatch, common, small):
    """Sets made of a few shared parts, in any order of shingles, against brute force."""
    if small:
        for name, value in (("BUFFER_ROWS", 7), ("PAIRS", 20), ("BUFFER_BYTES", 500)):
            monkeypatch.setattr(simhash, name, value)
    random = np.random.default_rng(23)
    parts = [np.unique(random.integers(0, 1 << 64, n, np.uint64, endpoint=False)) for n in (3, 8, 20, 40, 90)]
    sets = []
    for i in range(150):
        part = parts[i % 5]
        own = part[random.random(len(part)) < 0.93]
        own = np.unique(np.r_[own, random.integers(0, 1 << 64, random.integers(0, 2 + len(part) // 10), np.uint64, endpoint=False)])
        sets.append(own if len(own) else part)
    known = np.concatenate(parts) if common else np.empty(0, np.uint64)
    rank = np.argsort(known)
    roots = [i if i % 7 else 0 for i in range(150)]
    table = spark.createDataFrame([(i, len(x), roots[i], simhash.parities_of(x)) for i, x in enumerate(sets)], "id long, size long, root long, parities binary")
    first = [simhash.first_shingles(x, known[rank], rank, 0.8) for x in sets]
    begun = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(first)], "id long, first array<long>")
    found = {(r.a, r.b) for r in simhash.meeting_links(table, begun, 0.8).collect()}
    plain = [set(x.tolist()) for x in sets]
    assert all(a < b and roots[a] != roots[b] and alike(plain[a], plain[b], 0.6) for a, b in found)
    label = plain_components(list(range(150)), lambda x, y: (min(x, y), max(x, y)) in found)
    pairs = [(a, b) for a in range(150) for b in range(a) if roots[a] != roots[b] and alike(plain[a], plain[b])]
    assert len(pairs) > 100 and all(label[a] == label[b] for a, b in pairs)


def test_common_shingles_come_last(spark, monkeypatch):
    for name, value in (("COUNTED", 400), ("COMMON", 8), ("MOST_COMMON", 12)):
        monkeypatch.setattr(simhash, name, value)
    line = "this line is in every one of the texts here"
    texts = [(f"{line} " if i % 3 else "") + " ".join(f"t{i}w{k}" for k in range(12)) for i in range(60)]
    common = simhash.common_shingles(spark.createDataFrame([(t,) for t in [*texts, ""]], "text string").coalesce(1), 5)
    assert set(common.tolist()) == shingle_set(line) and len(common) == len(set(common.tolist()))
    rank = np.argsort(common)
    for text in texts:
        distinct = np.unique(simhash.shingle_hashes(text, 5))
        first = simhash.first_shingles(distinct, common[rank], rank, 0.8)
        assert len(first) == len(distinct) - int(np.ceil(0.8 * len(distinct))) + 1 and not set(first.tolist()) & set(common.tolist())
    distinct = np.sort(common)  # of common ones alone: the rarest first
    assert simhash.first_shingles(distinct, distinct, rank, 0.8).tolist() == common[:2].tolist()
    assert len(simhash.first_shingles(distinct[:0], distinct, rank, 0.8)) == 0
