"""The trie of conversation prefixes against one built turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from eventflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, `key` int, path string, members int, `rank` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], SCHEMA)


def plain(conversations):
    """Nodes of {conversation: [(role, text), ..]}, each by following every member."""
    nodes = defaultdict(list)
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            nodes[tuple(turns[:depth])].append(conv)
    children, out = defaultdict(list), []
    for prefix in nodes:
        if prefix:
            children[prefix[:-1]].append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(nodes, key=len, reverse=True):
        leaves[prefix] = sum(leaves[c] for c in children[prefix]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        saved[prefix] = (len(nodes[prefix]) - 1) * words + sum(saved[c] for c in children[prefix])
    for prefix, members in nodes.items():
        parent = min(nodes[prefix[:-1]]) if prefix else None
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(prefix))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(prefix), parent, len(members), len(children[prefix]), leaves[prefix], saved[prefix], digest))
    return sorted(out, key=repr)


def gathered(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in by_conv.items()}


def opened(conversations):
    out = {}
    for conv, own in conversations.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conversations.get(conv - (conv % 20 if conv >= 0 else -(-conv % 20)), [])
        out[conv] = base[:h] + own[h:]
    return out


def built(spark, rows, rebuild=False):
    turns = prefix_trie.turns(table(spark, rows))
    if rebuild:
        rebuilt = prefix_trie.with_shared_openings(turns, 20, 4)
    else:
        rebuilt = prefix_trie.with_shared_openings(turns, 1, 1)
    return sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.prefixes(rebuilt)).collect()), key=repr)


def random_rows(seed, convs, deepest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, deepest)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a b c", "x", "", "yes  no\tmaybe"])))
    return rows


def test_random(spark):
    rows = random_rows(1, 120, 6)
    assert built(spark, rows) == plain(gathered(rows))
    assert built(spark, rows, rebuild=True) == plain(opened(gathered(rows)))


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None),
        (1, 0, "user", "two words"),
        (2, 5, "user", "two words"),
        (None, 0, "user", "nowhere"),
        (-7, 0, "user", "x " * 20_000),
        (-25, 0, "user", "x " * 20_000),
        (-25, 1, None, "é b"),
        (41, 0, "user", "one turn, and none when rebuilt"),
        (3, 0, "a", "same turn"),
        (3, 0, "a", "same turn"),
    ]
    assert built(spark, rows) == plain(gathered(rows))
    assert built(spark, rows, rebuild=True) == plain(opened(gathered(rows)))


def test_empty_table_and_one_conversation(spark):
    assert built(spark, []) == []
    rows = [(4, t, "user", f"turn {t}") for t in range(5)]
    assert built(spark, rows) == plain(gathered(rows))


def test_many_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(100, 400) for t in range(3)]
    rows += [(c, t, "user", f"t{t}") for c in range(1000, 1040) for t in range(5)]
    rows += [(9, t, "user", f"long {t % 3}" if t else "t0") for t in range(2000)]
    assert built(spark, rows) == plain(gathered(rows))
