"""Conditions, paths, templates, JSON."""

import math
import operator
import re
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions import json_text, paths, templates
from eventflow.functions.conditions import all_of, condition
from eventflow.functions.patterns import is_valid_pattern, search


def check(df, cond):
    return [r[0] for r in df.select(condition(cond, df.schema)).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("active", 75, True), ("inactive", 25, False), (None, None, None)], "status string, score bigint, vip boolean"
    )


@pytest.mark.parametrize(
    "cond, expected",
    [
        ({"op": "eq", "field": "status", "value": "active"}, [True, False, False]),
        ({"op": "ne", "field": "status", "value": "active"}, [False, True, True]),
        ({"op": "gt", "field": "score", "value": 50}, [True, False, False]),
        ({"op": "lt", "field": "score", "value": 50.5}, [False, True, False]),
        ({"op": "gt", "field": "status", "value": 50}, [False, False, False]),
        ({"op": "gt", "field": "score", "value": "50"}, [False, False, False]),
        ({"op": "eq", "field": "score", "value": "75"}, [False, False, False]),
        ({"op": "eq", "field": "vip", "value": True}, [True, False, False]),
        ({"op": "eq", "field": "score", "value": True}, [False, False, False]),
        ({"op": "ne", "field": "gone", "value": 1}, [True, True, True]),
        ({"op": "eq", "field": "gone", "value": 1}, [False, False, False]),
        ({"op": "regex", "field": "status", "pattern": "^in"}, [False, True, False]),
        ({"op": "regex", "field": "status", "pattern": "(["}, [False, False, False]),
        ({"op": "regex", "field": "score", "pattern": "."}, [False, False, False]),
        ({"op": "not", "condition": {"op": "gt", "field": "score", "value": 50}}, [False, True, True]),
        ({"op": "and", "conditions": []}, [True, True, True]),
        ({"op": "or", "conditions": []}, [False, False, False]),
        ({"op": "eq", "field": "status", "value": None}, [False, False, True]),
        ({"op": "ne", "field": "status", "value": None}, [True, True, False]),
        ({"op": "eq", "field": "score", "value": [75]}, [False, False, False]),
        ({"op": "ne", "field": "status", "value": {"a": 1}}, [True, True, True]),
    ],
)
def test_two_valued_conditions(people, cond, expected):
    assert check(people, cond) == expected


def test_all_of_is_a_conjunction(people):
    rule = [{"op": "eq", "field": "status", "value": "active"}, {"op": "gt", "field": "score", "value": 50}]
    assert [r[0] for r in people.select(all_of(rule, people.schema)).collect()] == [True, False, False]


def test_unknown_op(people):
    with pytest.raises(ValueError):
        condition({"op": "between", "field": "score"}, people.schema)


def test_conditions_on_undeclared_json(spark):
    texts = ['{"a":{"n":5}}', '{"a":{"n":"5"}}', '{"a":{"t":"x","b":true}}', "{}"]
    df = spark.createDataFrame([(x,) for x in texts], "j string").select(F.parse_json("j").alias("v"))
    assert check(df, {"op": "gt", "field": "v.a.n", "value": 4}) == [True, False, False, False]
    assert check(df, {"op": "eq", "field": "v.a.n", "value": 5}) == [True, False, False, False]
    assert check(df, {"op": "eq", "field": "v.a.t", "value": "x"}) == [False, False, True, False]
    assert check(df, {"op": "eq", "field": "v.a.b", "value": True}) == [False, False, True, False]
    assert check(df, {"op": "ne", "field": "v.a.t", "value": "x"}) == [True, True, False, True]


def test_patterns(spark):
    assert is_valid_pattern("a+b") and not is_valid_pattern("([")
    df = spark.createDataFrame([("xabx",), (None,)], "t string")
    assert [r[0] for r in df.select(search(F.col("t"), "a.?b")).collect()] == [True, False]


def test_paths(spark):
    df = spark.createDataFrame([((("x",), {"k": "v"}),)], "a struct<b:struct<c:string>,m:map<string,string>>")
    row = df.select(
        paths.field(df.schema, "a.b.c"), paths.field(df.schema, "a/m/k"), paths.field(df.schema, "a.b.zzz"), paths.field(df.schema, "q")
    ).first()
    assert list(row) == ["x", "v", None, None]


def test_templates(spark):
    df = spark.createDataFrame([("Test", 3, True, None), (None, None, False, "n")], "name string, n int, ok boolean, note string")
    text = templates.render("Hello, {{ name }}!{{#if n}} n={{n}}{{#if ok}} ok{{/if}}{{/if}}{{#if note}} {{note}}{{/if}}", df.schema)
    assert [r[0] for r in df.select(text).collect()] == ["Hello, Test! n=3 ok", "Hello, ! n"]
    with pytest.raises(ValueError):
        templates.render("{{#if a}}", df.schema)
    with pytest.raises(ValueError):
        templates.render("{{/if}}", df.schema)


def test_decode_keeps_bad_rows(spark):
    texts = [b'{"k": 1}', b'{"k": "x"}', b'{"k": ', b"\xff\xfe", None]
    df = spark.createDataFrame([(x,) for x in texts], "payload binary")
    schema = T.StructType([T.StructField("k", T.LongType())])
    rows = json_text.decode(df, schema).select("body.k", "decode_error").collect()
    assert [r[0] for r in rows] == [1, None, None, None, None]
    assert [r[1] is None for r in rows] == [True, False, False, False, False]


def test_utf8(spark):
    df = spark.createDataFrame([(b"ok",), (b"a\xff",)], "b binary")
    strict = [r[0] for r in df.select(json_text.utf8(F.col("b"))).collect()]
    lossy = [r[0] for r in df.select(json_text.utf8(F.col("b"), lossy=True)).collect()]
    assert strict == ["ok", None] and lossy == ["ok", "a�"]


def test_unknown_keys(spark):
    df = spark.createDataFrame([('{"a":1,"z":2}',), ('{"a":1}',), ("[1]",)], "j string")
    assert [r[0] for r in df.select(json_text.unknown_keys(F.col("j"), ["a"])).collect()] == [["z"], [], []]


def _expected(cond, row):
    """The two-valued reading of a condition over a dict."""
    op = cond["op"]
    if op in ("and", "or"):
        parts = [_expected(c, row) for c in cond["conditions"]]
        return all(parts) if op == "and" else any(parts)
    if op == "not":
        return not _expected(cond["condition"], row)
    value = row.get(cond["field"])
    if op == "regex":
        return isinstance(value, str) and re.search(cond["pattern"], value) is not None
    wanted = cond["value"]
    numeric = isinstance(value, (int, float)) and isinstance(wanted, (int, float))
    if op in ("gt", "lt"):
        return numeric and (value > wanted if op == "gt" else value < wanted)
    equal = value is not None and (numeric or type(value) is type(wanted)) and value == wanted
    return equal if op == "eq" else not equal


_leaves = st.one_of(
    st.fixed_dictionaries(
        {
            "op": st.sampled_from(["eq", "ne", "gt", "lt"]),
            "field": st.sampled_from(["s", "n", "d", "gone"]),
            "value": st.sampled_from(["a", "b", "1", 0, 1, 2, 0.5, 1.5, -3]),
        }
    ),
    st.fixed_dictionaries(
        {"op": st.just("regex"), "field": st.sampled_from(["s", "n", "gone"]), "pattern": st.sampled_from(["a", "^b", "[ab]$", ""])}
    ),
)
_trees = st.recursive(
    _leaves,
    lambda inner: st.one_of(
        st.builds(lambda op, cs: {"op": op, "conditions": cs}, st.sampled_from(["and", "or"]), st.lists(inner, max_size=3)),
        st.builds(lambda c: {"op": "not", "condition": c}, inner),
    ),
    max_leaves=6,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(trees=st.lists(_trees, min_size=10, max_size=10))
def test_any_condition_tree(spark, trees):
    rows = [(s, n, d) for s in ("a", "ab", None) for n in (0, 1, None) for d in (0.5, 2.0, None)]
    df = spark.createDataFrame(rows, "s string, n bigint, d double")
    got = df.select("s", "n", "d", F.array(*[condition(t, df.schema) for t in trees]).alias("r")).collect()
    for row in got:
        assert row.r == [_expected(t, {"s": row.s, "n": row.n, "d": row.d}) for t in trees]


def test_numbers_compare_exactly(spark):
    """Columns of each type against numbers at the edges of doubles and integers, as Python's exact numbers compare."""
    big = 2**53
    longs = [None, 0, 1, -1, big, big + 1, -big - 1, 2**63 - 1, -(2**63)]
    decimals = [None, Decimal("0"), Decimal("0.1"), Decimal("-0.1"), Decimal(big + 1), Decimal("99999999999999999999.999999999999999999")]
    doubles = [None, 0.0, 0.1, 0.5, float(big), float(big + 2), 1e300, -1e300, math.inf, -math.inf]
    values = [0, 1, -1, 0.1, 0.5, -0.1, big, big + 1, -big - 1, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**25, 1e25, 10**400, -(10**400), float(big), 1e300]
    tables = [("bigint", longs), ("decimal(38,18)", decimals), ("double", doubles)]
    exact = lambda x: x if isinstance(x, float) and math.isinf(x) else Fraction(Decimal(str(x)))
    tests = {"eq": operator.eq, "gt": operator.gt, "lt": operator.lt}
    for kind, column in tables:
        df = spark.createDataFrame([(i, x) for i, x in enumerate(column)], f"i int, x {kind}")
        cases = [(op, v) for op in tests for v in values]
        found = df.select("i", *[condition({"op": op, "field": "x", "value": v}, df.schema).alias(f"c{n}") for n, (op, v) in enumerate(cases)])
        for row in found.collect():
            x = column[row.i]
            for n, (op, v) in enumerate(cases):
                # Doubles of both sides compare as doubles, which the shortest decimals keep.
                left = x if kind != "double" else (x if x is None or math.isinf(x) else Fraction(x))
                right = exact(v) if kind != "double" or isinstance(v, int) else Fraction(v)
                want = x is not None and tests[op](left if kind == "double" else exact(left), right)
                assert row[f"c{n}"] == want, (kind, x, op, v)


def test_numbers_in_variants_compare_exactly(spark):
    big = 2**53
    texts = [str(big), str(big + 1), "0.1", "0.10000000000000001", "1e300", str(10**25), '"7"', "null", "true"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.parse_json("t").alias("v"))
    hits = lambda op, value: [r.i for r in df.where(condition({"op": op, "field": "v", "value": value}, df.schema)).collect()]
    assert hits("gt", big) == [1, 4, 5] and hits("eq", big + 1) == [1] and hits("lt", big + 1) == [0, 2, 3]
    assert hits("eq", 0.1) == [2] and hits("gt", 0.1) == [0, 1, 3, 4, 5]
    assert hits("eq", 10**25) == [5] and hits("gt", 10**25) == [4] and hits("gt", 10**400) == []
    assert hits("ne", 7) == list(range(9))
