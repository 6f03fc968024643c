"""Personal data: base spans against a plain search, candidates by vote, reliabilities against known ones."""

import random
import re
from collections import Counter

from eventflow.llm import pii

from .samples import AWKWARD, docs

# The contract's patterns as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def result(spark, rows):
    return pii.personal_data(docs(spark, rows)).collect()


def compare(got, rows):
    base = Counter((r.id, tuple(tuple(s) for s in r.base)) for r in got)
    assert base == Counter((i, tuple(plain(t))) for i, t in rows)
    for r in got:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
        keys = [(pii.KINDS.index(s.kind), s.start) for s in r.spans]
        assert keys == sorted(keys)


SAMPLES = [
    "é😀 a.b@c.example.com, x@y and a@b.c_d@e.f@g.h",
    "from 10.0.0.256 to 1.2.3.4.5.6.7.8 at 000001.02.3.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112; 378282246310005.",
    "+1 (377) 555-0271, +49 30 1234, ++1 2345678901, +1234567890123456",
    "no data here",
]


def test_base_spans(spark):
    rows = list(enumerate(SAMPLES)) + AWKWARD
    compare(result(spark, rows), rows)


def test_random_texts(spark):
    rng = random.Random(3)
    pieces = ["a", "é", "9", "12", "255", ".", "@", "-", "+", " ", "(", ")", "_", "😀", "a@b.c", "1.2.3.4", "+1 23456789", "4111111111111111", ":", "at", "[.]"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(60)))) for i in range(1500)]
    compare(result(spark, rows), rows)


def test_long_runs(spark):
    units = ["a", "1", "1.", "a.", "+1", "12 ", "(1) ", "1:", "a@", "x at y.", "1[.]"]
    rows = [(i, unit * 2_000) for i, unit in enumerate(units)]
    compare(result(spark, rows), rows)
    # Too long for the plain search, which reads such runs again and again.
    assert len(result(spark, [(i, unit * 60_000) for i, unit in enumerate(units)])) == len(units)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_candidates(spark):
    rows = [(i, f"call +1 ({200 + i}) 555-0{100 + i} or mail u{i}@host{i}.com from 10.1.2.{i}, card 4111 1111 1111 1111") for i in range(60)]
    rows += [(100 + i, f"order no. {7_000_000_000_000 + 7919 * i}, dated 2024-01-1{i % 9}, id {2_345_678 + i}") for i in range(60)]
    masked = (500, "write mail to jane.doe (at) example (dot) com, phone (377) 555-0271, host 192[.]168[.]0[.]1")
    got = {r.id: [tuple(s) for s in r.spans] for r in result(spark, [*rows, masked])}
    found = {masked[1][a:b] for _, a, b in got[500]}
    assert {"jane.doe (at) example (dot) com", "(377) 555-0271", "192[.]168[.]0[.]1"} <= found
    assert not any(got[100 + i] for i in range(60) if not plain(rows[60 + i][1]))


def test_reliabilities_are_recovered():
    rng = random.Random(5)
    right = {"shape": 0.95, "grouping": 0.8, "known": 0.7, "cue": 0.9, "other": 0.75, "after": 0.85}
    counts = Counter()
    for _ in range(20_000):
        truth = rng.random() < 0.3
        votes = tuple("-" if rng.random() < 0.2 else ("y" if (rng.random() < right[name]) == truth else "n") for name in pii.LABELERS)
        counts["card", False, votes] += 1
    got = pii.estimate([(*key, n) for key, n in counts.items()])
    assert abs(got.share["card"] - 0.3) < 0.02
    for name, p in right.items():
        no_data, data = got.says_yes["card", name]
        assert abs(data - p) < 0.03 and abs(1 - no_data - p) < 0.03


def test_plan_has_no_python(spark, data):
    plan = pii.personal_data(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
