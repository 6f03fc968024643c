"""The rule index against testing every rule, with one and with many slabs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventflow.operators import rule_index
from eventflow.sources import topics
from eventflow.streaming import sinks

RULES = "k string, low double, high double, priority int, ord long, decision string"


def best(rules, key, x, low_closed, high_closed):
    def holds(low, high):
        if low is not None and low != low:
            return False
        high = None if high is not None and high != high else high
        if x is None:
            return low is None and high is None
        above = low is None or x > low or (low_closed and x == low)
        return above and (high is None or x < high or (high_closed and x == high))

    found = [r for r in rules if r[0] == key and holds(r[1], r[2]) and not _empty(r[1], r[2], low_closed, high_closed)]
    return min(found, key=lambda r: (r[3] is None, -(r[3] or 0), r[4], r[5]))[5] if found else "unknown"


def _empty(low, high, low_closed, high_closed):
    return low is not None and high is not None and (low > high or (low == high and not (low_closed and high_closed)))


def random_rules(seed, n):
    rng = random.Random(seed)
    rules = []
    for i in range(n):
        low = rng.choice([None, float("nan"), *[float(rng.randrange(200))] * 20])
        high = rng.choice([None, *[(low or 0.0) + rng.choice([0, 1, 2, 5, 30, 150])] * 12])
        rules.append((rng.choice(["hot"] * 8 + ["b", None]), low, high, rng.choice([None, *range(30)]), i, f"d{i}"))
    return rules


@pytest.mark.parametrize(("low_closed", "high_closed"), [(True, False), (False, True), (True, True)])
@pytest.mark.parametrize("slab", [40, 50_000])
def test_against_all_rules(spark, monkeypatch, slab, low_closed, high_closed):
    monkeypatch.setattr(rule_index, "SLAB_BOUNDS", slab)
    monkeypatch.setattr(rule_index, "FANOUT", 5)
    rules = random_rules(slab, 600)
    rows = [(i, k, x) for i, (k, x) in enumerate((k, x) for k in ("hot", "b", None, "no rules") for x in (None, -1.0, *[v / 2 for v in range(0, 800, 3)], 1e9))]
    index = rule_index.build(spark.createDataFrame(rules, RULES), ["k"], "double", low_closed=low_closed, high_closed=high_closed)
    assert len(index.levels) >= 2
    got = rule_index.decide(spark.createDataFrame(rows, "id int, k string, x double"), index, "x").collect()
    assert {r.id: r.decision for r in got} == {i: best(rules, k, x, low_closed, high_closed) for i, k, x in rows}


def test_times_and_whole_numbers(spark):
    day = datetime(2024, 1, 1)
    rules = [(1, day + timedelta(days=d), day + timedelta(days=d + 10), d, d, f"from {d}") for d in range(0, 50, 5)]
    table = spark.createDataFrame(rules, "k int, low timestamp, high timestamp, priority int, ord int, decision string")
    index = rule_index.build(table, ["k"], "timestamp")
    rows = spark.createDataFrame([(1, day + timedelta(days=d, hours=12)) for d in range(-1, 70, 7)], "k int, ts timestamp")
    want = {r.ts: "unknown" if not 0 <= (r.ts - day).days < 55 else f"from {min((r.ts - day).days // 5 * 5, 45)}" for r in rows.collect()}
    assert {r.ts: r.decision for r in rule_index.decide(rows, index, "ts").collect()} == want

    large = spark.createDataFrame([(1, 2**53 + 1, None, 1, 1, "beyond")], "k int, low long, high long, priority int, ord int, decision string")
    rows = spark.createDataFrame([(1, 2**53), (1, 2**53 + 1)], "k int, x long")
    assert [r.decision for r in rule_index.decide(rows, rule_index.build(large, ["k"], "long"), "x").orderBy("x").collect()] == ["unknown", "beyond"]


def test_no_rules(spark):
    index = rule_index.build(spark.createDataFrame([], RULES), ["k"], "double")
    rows = spark.createDataFrame([("hot", 1.0, "old")], "k string, x double, decision string")
    assert rule_index.decide(rows, index, "x", "none").collect() == [("hot", 1.0, "none")]


def test_no_row_and_no_node_holds_many_rules(spark):
    """20,000 rules of one key, 50,000 rows: nodes stay small."""
    n = 20_000
    rules = spark.range(n).select(
        F.lit("hot").alias("k"), F.col("id").cast("double").alias("low"), (F.col("id") + 1 + F.col("id") % 977).cast("double").alias("high"),
        (F.col("id") * 7919 % 1009).alias("priority"), F.col("id").alias("ord"), F.concat(F.lit("d"), "id").alias("decision"),
    )
    index = rule_index.build(rules, ["k"], "double")
    assert all(level.agg(F.max(F.size("entries"))).first()[0] <= rule_index.FANOUT for level in index.levels)
    rows = spark.range(50_000).select(F.lit("hot").alias("k"), (F.col("id") * 0.4).alias("x"))
    got = {r.x: r.decision for r in rule_index.decide(rows, index, "x").where("x < 40 OR x > 19900").collect()}
    for x, decision in got.items():
        open_rules = [i for i in range(max(0, int(x) - 977), min(n, int(x) + 1)) if i <= x < i + 1 + i % 977]
        want = min(open_rules, key=lambda i: (-(i * 7919 % 1009), i), default=None)
        assert decision == ("unknown" if want is None else f"d{want}")


def test_a_stream_is_decided_alike(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type", "value")
    rules = [(k, float(v), float(v + 40), v % 9, v, f"{k}{v}") for k in ("click", "view") for v in range(0, 300, 10)]
    index = rule_index.build(spark.createDataFrame(rules, RULES), ["k"], "double")
    events = events.withColumnRenamed("event_type", "k")
    events.write.parquet(str(tmp_path / "in"))
    stream = topics.read_stream(spark, topics.Topic(str(tmp_path / "in"), events.schema))
    out = str(tmp_path / "out")
    assert sinks.finish(sinks.append(rule_index.decide(stream, index, "value"), out, "rules", str(tmp_path / "cp")), 120)
    want = rule_index.decide(events, index, "value")
    assert sorted(map(repr, spark.read.schema(want.schema).parquet(out).collect())) == sorted(map(repr, want.collect()))


def test_a_row_looks_at_few_entries_of_a_node(spark):
    index = rule_index.build(spark.createDataFrame(random_rules(4, 300), RULES), ["k"], "double")
    decided = rule_index.decide(spark.createDataFrame([("hot", 7.0)], "k string, x double"), index, "x")
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(__entries" not in plan and "aggregate(" in plan
