"""Routes from a table against a search of each pattern in each payload."""

import random
import re

import pytest
from pyspark.sql import functions as F

import eventflow.plans.queries  # noqa: F401
from eventflow.functions.patterns import needed_texts, search
from eventflow.operators import route_index
from eventflow.plans.registry import QUERIES

SCHEMA = "route_id long, pattern string, target string, priority int, ord long"


@pytest.mark.parametrize(
    "pattern, texts",
    [
        ("error", ["error"]), ("error|warn(ing)?", ["error", "warn"]), ("a.bcd+e", ["bcd"]), ("abc?d", ["ab"]), ("abc*", ["ab"]),
        ("xy{0,2}zz", ["zz"]), (r"1\.5 \(net\)", ["1.5 (net)"]), (r"\d+ items\b", [" items"]), (r'"k": 9[0-9]', ['"k": 9']),
        ("(?:one|two) three(x)", [" three"]), (r"ab[\]x]cde", ["cde"]), ("(a(b)[)]c)def", ["def"]), ("ab+cd", ["ab"]), ("ü€😀?", ["ü€"]),
        ("", None), ("a", None), ("error|.", None), ("(?i)error", None), ("abc(?=def)", None), (r"\Qa.b\E", None), (r"\x41bcd", None),
        ("[[a]bc]def", None), ("[]a]bcd", None), (r"(\Q)\E)abc", None), ("abc|", None), ("a?b?c", None), ("abc)", None), ("[abc", None),
    ],
)
def test_needed_texts(pattern, texts):
    assert needed_texts(pattern) == texts


ATOMS = ["a", "b", "c", "ab", ".", "[ab]", "[^c]", "(a|bc)", "(?:b)", r"\.", r"\d", "^", "$", "|", "(?i)", r"\Qc.\E", "😀", r"\w", "(", "]"]
TIMES = ["", "", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]


def test_every_pattern_as_if_searched(spark):
    draw = random.Random(3)
    patterns = ["".join(draw.choice(ATOMS) + draw.choice(TIMES) for _ in range(draw.randrange(6))) for _ in range(300)]
    patterns += [None, "", "ab", "ab", "(["]
    routes = [(i, p, f"t{i}", draw.choice([1, 2, None]), i % 50) for i, p in enumerate(patterns)]
    payloads = ["".join(draw.choice("abcABC.19 😀\n") for _ in range(draw.randrange(12))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    table = route_index.load(spark.createDataFrame(routes, SCHEMA))
    assert 30 < len(table.always) < len(table.ids) < len(patterns)
    got = {r.id: [x.route_id for x in r.routes] for r in route_index.matching(df, table).collect()}
    hits = df.select("id", F.array(*[search(F.col("payload"), p) if p is not None else F.lit(False) for p in patterns]).alias("hit")).collect()
    best_first = sorted(range(len(routes)), key=lambda i: (routes[i][3] is None, -(routes[i][3] or 0), routes[i][4], i))
    assert got == {r.id: [str(i) for i in best_first if r.hit[i]] for r in hits}


def test_five_thousand_routes(spark):
    draw = random.Random(8)
    routes = [(i, f"order {i}\\b|code{i * 7}x", f"t{i % 9}", i % 5, i) for i in range(5000)]
    payloads = [f"see order {draw.randrange(6000)}, code{draw.randrange(6000) * 7}x or code{draw.randrange(50)}xy" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    table = route_index.load(spark.createDataFrame(routes, SCHEMA))
    assert not table.always
    got = {r.id: [(int(x.route_id), x.target) for x in r.routes] for r in route_index.matching(df, table).collect()}
    for number, payload in enumerate(payloads):
        hits = {int(n) for n in re.findall(r"order (\d+)\b", payload)} | {int(n) // 7 for n in re.findall(r"code(\d+)x", payload) if int(n) % 7 == 0}
        # "code7x" is also found in "code7xy"; "order 12" is not in "order 123".
        want = sorted((h for h in hits if h < 5000), key=lambda i: (-(i % 5), i))
        assert got[number] == [(i, f"t{i % 9}") for i in want]


def test_limits_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([("x",)], "payload string")
    empty = route_index.load(spark.createDataFrame([], SCHEMA))
    assert [r.routes for r in route_index.matching(df, empty).collect()] == [[]]
    assert route_index.matching(df.limit(0), empty).count() == 0
    monkeypatch.setattr(route_index, "MOST_ROUTES", 1)
    with pytest.raises(ValueError, match="2 routes"):
        route_index.load(spark.createDataFrame([(1, "a", "t", 0, 0), (2, "b", "t", 0, 1)], SCHEMA))


def test_stored_routes_are_found_as_if_searched(spark, monkeypatch):
    """Any number of routes: beyond what a loaded table may hold, with repeats, long texts and hot ones."""
    monkeypatch.setattr(route_index, "MOST_ROUTES", 10)
    monkeypatch.setattr(route_index, "CHARS", 30)
    draw = random.Random(5)
    patterns = ["".join(draw.choice(ATOMS) + draw.choice(TIMES) for _ in range(draw.randrange(6))) for _ in range(200)]
    long = "x" * 70 + "é😀 and more"
    patterns += [None, "", "ab", "ab", "([", "ab|bc|ca", long, long[:64], long[:65] + "|zz", "x" * 200]
    routes = [(i, p, f"t{i}" if i % 9 else None, draw.choice([1, 2, None]), i % 50) for i, p in enumerate(patterns)]
    payloads = ["".join(draw.choice("abcABC.19 😀\n") for _ in range(draw.randrange(12))) for _ in range(60)] + [None, "", "a"] * 2
    payloads += [long, "q" + long, long[:66], "x" * 300, "abcab"] * 2
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    table = route_index.stored(spark.createDataFrame(routes, SCHEMA).repartition(5))
    found = route_index.matching(df, table)
    assert found.columns == ["id", "payload", "routes"] and found.count() == len(payloads)
    got = {r.id: [(x.route_id, x.target) for x in r.routes] for r in found.collect()}
    hits = df.select("id", F.array(*[search(F.col("payload"), p) if p is not None else F.lit(False) for p in patterns]).alias("hit")).collect()
    best_first = sorted(range(len(routes)), key=lambda i: (routes[i][3] is None, -(routes[i][3] or 0), routes[i][4], i))
    assert got == {r.id: [(str(i), routes[i][2]) for i in best_first if r.hit[i]] for r in hits}
    empty = route_index.stored(spark.createDataFrame([], SCHEMA))
    assert [r.routes for r in route_index.matching(df.limit(2), empty).collect()] == [[], []]
    assert route_index.matching(df.limit(0), table).count() == 0


def test_query_beyond_the_routes_one_table_may_hold(spark, data, monkeypatch):
    before = sorted(map(tuple, QUERIES["route_table"](spark, data).collect()))
    monkeypatch.setattr(route_index, "MOST_ROUTES", 10)
    assert sorted(map(tuple, QUERIES["route_table"](spark, data).collect())) == before
