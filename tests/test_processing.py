"""Validation, normalisation, imputation."""

import pytest
from pyspark.sql import functions as F

from eventflow.operators import impute, normalize, validate
from eventflow.operators.validate import FieldRule, Rules


def kinds(df, rules):
    return [[e["kind"] for e in r[0]] for r in validate.validate(df, rules).select("errors").collect()]


def test_required_name(spark):
    df = spark.createDataFrame([("Test",), (None,), ("",)], "name string")
    rules = Rules({"name": FieldRule(required=True, type="string", min_length=1, max_length=100)})
    assert kinds(df, rules) == [[], ["missing_field"], ["field_validation"]]


def test_absent_field(spark):
    df = spark.range(1)
    assert kinds(df, Rules({"name": FieldRule(required=True)})) == [["missing_field"]]
    assert kinds(df, Rules({"name": FieldRule(pattern="x")})) == [[]]


def test_messages(spark):
    df = spark.createDataFrame([("x",)], "a string")
    rules = Rules({"a": FieldRule(type="number"), "b": FieldRule(required=True)}, row=({"custom": "a = 'y'"},))
    text = validate.validate(df, rules).select(validate.messages()).first()[0]
    assert text.split("; ") == [
        "Invalid type for field 'a': expected number, got string",
        "Missing required field: b",
        "Validation error: a = 'y'",
    ]


def test_declared_and_variant_types(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, true AS b, array(1) AS a, parse_json('{\"x\":1}') AS v")
    ok = {"i": "number", "d": "number", "b": "boolean", "a": "array", "v": "object", "v.x": "integer"}
    assert kinds(df, Rules({k: FieldRule(type=t) for k, t in ok.items()})) == [[]]
    bad = {"i": "boolean", "d": "integer", "a": "object", "v": "array"}
    assert kinds(df, Rules({k: FieldRule(type=t) for k, t in bad.items()})) == [["invalid_type"] * 4]


def test_values_and_payloads_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, "2024-01-02"), (3, "2024-01-03")], "x int, y string").withColumn("y", F.col("y").cast("date"))
    rules = validate.Rules(fields={"x": validate.FieldRule(allowed_values=("1", "one")), "y": validate.FieldRule(allowed_values=("2024-01-02", "soon"))})
    checked = validate.validate(df, rules).orderBy("x").collect()
    assert [len(r.errors) for r in checked] == [0, 2]
    payloads = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "z": 2}',), ('{"a": ',), (None,)], "p string")
    found = [r[0] for r in payloads.select(validate.strict_schema_errors(F.col("p"), ["a"])).collect()]
    assert [len(e) for e in found] == [0, 1, 1, 1] and found[2][0]["message"].endswith("invalid JSON")


def test_row_rules(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    rule = {"all": [{"not": {"custom": "x > 3"}}, {"any": [{"custom": "x = 1"}, {"custom": "x IS NULL"}]}]}
    assert kinds(df, Rules(row=(rule,))) == [[], ["custom"], []]


def test_no_rules_pass_everything(spark):
    df = spark.createDataFrame([("data",)], "test string")
    accepted, rejected = validate.split(validate.validate(df, Rules()))
    assert [r.test for r in accepted.collect()] == ["data"] and rejected.count() == 0


def test_text_steps(spark):
    df = spark.createDataFrame([("  Héllo, World_1!\n",)], "t string")
    cleaned = normalize.clean_text(F.col("t"), ["trim", "lowercase", "remove_special_chars"])
    assert df.select(cleaned).first()[0] == "héllo world1"


def test_features(spark):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 13:00:00' AS ts, 20 AS amount, 'FR' AS country, 'DE' AS home_country")
    out = normalize.features(df, ["amount", "tx_hour", "is_foreign_country", "big: amount > 10"], keep=["id"])
    assert out.first().asDict() == {"id": 1, "amount": 20, "tx_hour": 13, "is_foreign_country": True, "big": True}
    with pytest.raises(KeyError):
        normalize.features(df, ["no_such_feature"])


def test_units(spark):
    df = spark.createDataFrame([(2.0, "km"), (3.0, "m"), (1.0, "mile")], "x double, u string")
    assert [r[0] for r in df.select(normalize.convert(F.col("x"), F.col("u"), {"km": 1000, "m": 1})).collect()] == [2000.0, 3.0, None]


def test_median(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2)] + [(None,)], "x double")
    filled = impute.impute(df, ["x"], "median_imputation")
    assert sorted(r.x for r in filled.collect()) == [1, 2, 3, 4, 5]


def test_mean(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 4.0), (None, 8.0)], "x double, y double")
    assert [tuple(r) for r in impute.impute(df, ["x", "y"], "mean_imputation").collect()] == [(1, 6), (3, 4), (2, 8)]
    with pytest.raises(ValueError):
        impute.impute(df, ["x"], "guess")
