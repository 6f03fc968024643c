"""Ordered operators, quantiles, throttling, batches and reviews against brute force, with hot keys."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventflow.operators import ordered, quantiles, review
from eventflow.operators.batches import micro_batches
from eventflow.operators.review import ReviewConfig
from eventflow.operators.throttle import throttle

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    """2,000 rows; one key has a third of them, another key is NULL."""
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        at = START + timedelta(seconds=rng.randrange(40 * 3600))
        rows.append((i, key, at, rng.choice([None, rng.uniform(-50, 50), 7.0])))
    return spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, x double").cache()


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def hour():
    return F.date_trunc("HOUR", "ts")


def key_order():
    return Window.partitionBy("k").orderBy("ts", "id")


def test_rank(events):
    plain = events.withColumn("n", F.row_number().over(key_order()).cast("bigint"))
    same(ordered.ranked(events, ["k"], [F.col("ts"), F.col("id")], hour(), "n"), plain)


def test_running_sum(events):
    whole = events.withColumn("y", F.col("id").cast("bigint"))
    plain = whole.withColumn("s", F.sum("y").over(key_order().rowsBetween(Window.unboundedPreceding, 0)))
    same(ordered.running(whole, ["k"], [F.col("ts"), F.col("id")], hour(), {"s": F.col("y")}), plain)


def test_previous(events):
    plain = events.withColumn("p", F.lag("x").over(key_order()))
    same(ordered.previous(events, ["k"], ["ts", "id"], hour(), "x", "p"), plain)


@pytest.mark.parametrize("size, block", [(1, 16), (10, 16), (10, 10), (30, 4)])
def test_trailing(events, size, block):
    plain = events.withColumn("h", F.collect_list("id").over(key_order().rowsBetween(-(size - 1), 0)))
    got = ordered.trailing(events, ["k"], [F.col("ts"), F.col("id")], hour(), size, F.col("id"), "h", block)
    same(got, plain)


def test_most_recent(events):
    plain = events.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("id")))).where("n <= 4").drop("n")
    got = ordered.most_recent(events, ["k"], [F.desc("id")], 4)
    same(got, plain)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_most_recent_of_many(events):
    plain = events.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("id")))).where("n <= 1200").drop("n")
    same(ordered.most_recent(events, ["k"], [F.desc("id")], 1200, chunk=-F.floor(F.col("id") / 100)), plain)
    same(ordered.most_recent(events, ["k"], [F.desc("id")], 1200), plain)


@pytest.mark.parametrize("keys", [["k"], ["k", "day"], []])
def test_quantiles_equal_the_builtin(events, keys):
    events = events.withColumn("day", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    qs = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = quantiles.quantiles(events, keys, F.col("x"), qs)
    plain = events.groupBy(*keys).agg(*[F.percentile("x", q).alias(n) for n, q in qs.items()])

    def rounded(df):
        return df.select(*keys, *[F.round(n, 9).alias(n) for n in qs])

    same(rounded(got), rounded(plain))


@pytest.mark.parametrize("values", [[0.0] * 50, [1e-300, 1.0, 1e300, -1e300], [3.0], [-1.0, -2.0, 0.0, 2.0, 1.0, 1.0 + 1e-12]])
def test_quantiles_of_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.quantiles(df, [], F.col("x"), {"a": 0.25, "b": 0.5}).first()
    assert np.allclose([got.a, got.b], np.quantile(values, [0.25, 0.5]), rtol=1e-12)


def test_quantiles_of_infinite_values(spark):
    values = [float("-inf"), 1.0, 2.0, float("inf"), float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.quantiles(df, [], F.col("x"), {"a": 0.0, "b": 0.2, "c": 0.8, "d": 1.0}).first()
    assert list(got)[:3] == [float("-inf"), 1.0, float("inf")] and np.isnan(got.d)


def test_quantiles_on_random_skewed_values(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 4, 4000), -rng.exponential(1, 2000), np.full(3000, 2.5)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = quantiles.quantiles(df, [], F.col("x"), {f"q{i}": i / 20 for i in range(21)}).first()
    assert np.allclose(list(got), np.quantile(values, [i / 20 for i in range(21)]), rtol=1e-12)


def test_quantiles_start_no_job_when_built(events, spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    quantiles.quantiles(events, ["k"], F.col("x"), {"a": 0.5})
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_quantiles_of_a_hot_key_and_null_keys(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(1.6e9, 1e4, 60_000)
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 50, float(v)) for i, v in enumerate(x)], "k int, x double")
    got = {r.k: r.m for r in quantiles.quantiles(df, ["k"], F.col("x"), {"m": 0.37}).collect()}
    want = {}
    for i, v in enumerate(x):
        want.setdefault(None if i % 3 == 0 else i % 50, []).append(v)
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], np.quantile(v, 0.37), rtol=1e-12) for k, v in want.items())


@pytest.mark.parametrize("ttl", [1, 600, 3600, 100_000])
@pytest.mark.parametrize("chunk", ["MINUTE", "HOUR", "DAY", "YEAR"])
def test_throttle(events, ttl, chunk):
    expected, last = set(), {}
    for row in sorted(events.collect(), key=lambda r: (r.ts, r.id)):
        if row.k not in last or row.ts > last[row.k] + timedelta(seconds=ttl):
            last[row.k] = row.ts
            expected.add(row.id)
    got = throttle(events, "k", "ts", F.date_trunc(chunk, "ts"), ttl, tie="id").collect()
    assert {r.id for r in got} == expected and len(got) == len(expected)


def test_throttle_keeps_its_place_across_batches(spark, events):
    """Arrow batches of 7 rows cut every group into pieces."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ttl, chunk in [(600, "DAY"), (20_000, "HOUR")]:
            test_throttle(events, ttl, chunk)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_throttle_of_an_even_beat(spark):
    """A steady beat never falls into step: the worst case for the summaries."""
    rows = [(i, "k", START + timedelta(seconds=i)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz")
    got = throttle(df, "k", "ts", F.date_trunc("MINUTE", "ts"), 6.5, tie="id")
    assert sorted(r.id for r in got.collect()) == list(range(0, 500, 7))


def test_throttle_forever(events):
    first = {}
    for row in sorted(events.collect(), key=lambda r: (r.ts, r.id)):
        first.setdefault(row.k, row.id)
    got = throttle(events, "k", "ts", hour(), None, tie="id")
    assert {r.k: r.id for r in got.collect()} == first


def test_micro_batches(events):
    expected, state = {}, {}
    for row in sorted(events.collect(), key=lambda r: (r.ts, r.id)):
        before, session, position = state.get(row.k, (None, 0, 0))
        opens = before is None or row.ts - before > timedelta(seconds=90)
        session, position = (session + 1, 1) if opens else (session, position + 1)
        state[row.k] = (row.ts, session, position)
        expected[row.id] = (session, position, (position - 1) // 4)
    got = micro_batches(events, ["k"], "ts", ["ts", "id"], hour(), size=4, idle_seconds=90)
    assert {r.id: (r.session, r.position, r.batch) for r in got.collect()} == expected


def fold(requests, decisions, needed, timeout):
    """The review state machine, one decision at a time."""
    state = {rid: ["pending", 0, created + timedelta(seconds=timeout), None, created] for rid, created in requests}
    orphans = []
    for did, rid, reviewer, decision, at in sorted(decisions, key=lambda d: (d[4], d[0])):
        s = state.get(rid)
        if s is None or s[0] != "pending" or not s[4] <= at <= s[2]:
            orphans.append(did)
            continue
        s[1] += decision == "approved"
        if s[1] >= needed:
            s[0], s[3] = "approved", at
        elif decision == "rejected":
            s[0], s[3] = "rejected", at
    return {rid: (s[0] if s[0] != "pending" else "timed_out", s[3]) for rid, s in state.items()}, sorted(orphans)


@pytest.fixture(scope="module")
def review_rows():
    rng = random.Random(11)
    requests = [(i, START + timedelta(hours=i)) for i in range(60)]
    decisions = []
    for d in range(900):
        rid = 0 if d % 3 == 0 else rng.randrange(70)
        at = START + timedelta(hours=rng.randrange(min(rid, 59) - 40, min(rid, 59) + 90))
        decisions.append((d, rid, rng.randrange(5), rng.choices(["approved", "rejected", "pending"], [6, 1, 2])[0], at))
    return requests, decisions


@pytest.mark.parametrize("needed", [0, 1, 2, 3, 1001])
def test_review_fold(spark, review_rows, needed):
    requests, decisions = review_rows
    config = ReviewConfig(required_approvals=needed, timeout_seconds=48 * 3600)
    opened = spark.createDataFrame(requests, "rid int, created timestamp_ntz")
    opened = review.submit(opened, F.col("rid"), F.col("created"), F.col("rid"), config)
    given = spark.createDataFrame(decisions, "did int, review_id int, reviewer int, decision string, decided_at timestamp_ntz")
    expected, orphans = fold(requests, decisions, needed, 48 * 3600)
    by_day = review.closing_decisions(opened, given, config, ["did"], F.date_trunc("DAY", "decided_at"))
    assert sorted(by_day.collect()) == sorted(review.closing_decisions(opened, given, config, ["did"]).collect())
    got = review.resolve(opened, given, config, ["did"]).collect()
    assert {r.review_id: (r.status, r.closed_at) for r in got} == expected
    assert sorted(r.did for r in review.orphans(opened, given, config, ["did"]).collect()) == orphans


def test_all_reviewers_have_to_approve(spark):
    day = lambda n: START + timedelta(days=n)
    rows = [
        (1, 1, "ann", "approved", day(1)), (2, 1, "ann", "approved", day(2)), (3, 1, "cat", "approved", day(3)), (4, 1, "bob", "approved", day(4)),
        (5, 2, "ann", "approved", day(1)), (6, 2, "ann", "approved", day(2)), (7, 2, "cat", "approved", day(3)),
        (8, 3, "ann", "approved", day(1)), (9, 3, "eve", "rejected", day(2)), (10, 3, "bob", "approved", day(3)),
    ]
    given = spark.createDataFrame(rows, "did int, review_id int, reviewer string, decision string, decided_at timestamp_ntz")
    config = ReviewConfig(default_reviewers=("ann", "bob"), require_all_reviewers=True, timeout_seconds=30 * 86400)
    asked = spark.createDataFrame([(i, START) for i in (1, 2, 3)], "rid int, created timestamp_ntz")
    opened = review.submit(asked, F.col("rid"), F.col("created"), F.col("rid"), config)
    got = {r.review_id: (r.status, r.closed_at) for r in review.resolve(opened, given, config, ["did"]).collect()}
    assert got == {1: ("approved", day(4)), 2: ("timed_out", None), 3: ("rejected", day(2))}


def test_review_counts(spark):
    rows = [("test", d) for d in ("approved", "rejected", "approved", "pending")]
    df = spark.createDataFrame(rows, "review_id string, decision string")
    assert review.counts(df).first().asDict() == {"review_id": "test", "approvals": 2, "rejections": 1}


def test_decisions_are_trimmed_before_the_shuffle(spark, review_rows):
    requests, decisions = review_rows
    config = ReviewConfig(required_approvals=2)
    opened = spark.createDataFrame(requests, "review_id int, created_at timestamp_ntz").withColumn("timeout_seconds", F.lit(9).cast("bigint"))
    given = spark.createDataFrame(decisions, "did int, review_id int, reviewer int, decision string, decided_at timestamp_ntz")
    plan = review.closing_decisions(opened, given, config, ["did"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_timeout_actions(spark):
    df = spark.createDataFrame([(1, "timed_out"), (2, "approved")], "review_id int, status string")
    for action, status, topic in [
        ("approve", "approved", "reviews.1.completed"),
        ("reject", "rejected", "reviews.1.completed"),
        ("escalate", "escalated", "boss"),
    ]:
        rows = review.on_timeout(df, action, "boss").orderBy("review_id").collect()
        assert (rows[0].final_status, rows[0].topic) == (status, topic)
        assert (rows[1].final_status, rows[1].topic) == ("approved", "reviews.2.completed")


def test_group_runs_do_not_mix_batches():
    import pandas as pd

    from eventflow.operators.throttle import _whole_groups

    frames = [pd.DataFrame({"g": list(g), "v": range(len(g))}) for g in ("aab", "bb", "", "bcc", "d")]
    runs = [list(p.g) for p in _whole_groups(iter(frames), "g")]
    assert [x for run in runs for x in run] == list("aabbbbccd")
    seen = defaultdict(int)
    for run in runs:
        for g in set(run):
            seen[g] += 1
    assert set(seen.values()) == {1}
