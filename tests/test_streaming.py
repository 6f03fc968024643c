"""Streams give what the batch forms give."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventflow.functions import json_text
from eventflow.operators import decide, prompts, review, route, validate
from eventflow.operators.decide import Rule
from eventflow.operators.review import ReviewConfig
from eventflow.operators.route import Action, Route
from eventflow.operators.throttle import throttle as batch_throttle
from eventflow.operators.validate import FieldRule, Rules
from eventflow.plans.fraud import fraud_detection
from eventflow.plans.queries.common import BODY
from eventflow.plans.sentiment import sentiment
from eventflow.sources import topics
from eventflow.streaming import sinks, state, windows

START = datetime(2024, 1, 1)


def in_files(df, folder, order, parts=3):
    """Write a table as ``parts`` files that a stream reads one per trigger, in order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = df.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return topics.read_stream(df.sparkSession, topics.Topic(folder, df.schema), batch_size=1)


def run(df, tmp_path, name):
    out = str(tmp_path / f"out-{name}")
    query = sinks.append(df, out, name, str(tmp_path / f"cp-{name}"))
    assert sinks.finish(query, 120)
    return df.sparkSession.read.schema(df.schema).parquet(out)


@pytest.fixture(scope="module")
def events(spark, data):
    return spark.read.parquet(f"{data}/events.parquet")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_flagship_flow_to_topics(spark, events, tmp_path):
    stream = fraud_detection(in_files(events, str(tmp_path / "in"), "ts"))
    root = str(tmp_path / "bus")
    query = sinks.publish(stream, root, "flagship", str(tmp_path / "cp"))
    assert sinks.finish(query, 120)
    assert sorted(p for p in os.listdir(root) if p.startswith("batch=")) == ["batch=0", "batch=1", "batch=2"]
    got = spark.read.parquet(root).drop("batch")
    expected = fraud_detection(events)
    same(got.select(*expected.columns), expected)


def stateless(events):
    """Decode, validate, decide and route, one after another."""
    payload = F.when(F.col("event_type") == "error", "{").otherwise(F.col("props"))
    sent = topics.envelope(events, F.col("event_id"), F.col("event_type"), payload, F.col("ts"), keep=["value"])
    decoded = json_text.decode(sent, BODY)
    checked = validate.validate(decoded, Rules({"body.k": FieldRule(required=True), "value": FieldRule(custom_validator="value < 300")}))
    rules = [Rule("big", "review", ({"op": "gt", "field": "value", "value": 50}, {"op": "lt", "field": "body.k", "value": 90}))]
    decided = decide.decide(checked, rules, default="accept")
    routed = validate.route_errors(decided, "ok", "errors", "payload")
    routes = [Route("v", "purchase|view", (Action("publish", target="a"), Action("log", message="m"))), Route("e", "error", (Action("publish", target="b"),))]
    out = route.route(routed, routes, payload="subject", stop_after_first_match=False)
    return out.select("message_id", "topic", "payload", "decision", "action_no", "action.type", "action.target")


def test_stateless_operators(spark, events, tmp_path):
    stream = stateless(in_files(events, str(tmp_path / "in"), "ts"))
    same(run(stream, tmp_path, "stateless"), stateless(events))


def test_text_flow(spark, data, tmp_path):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    same(run(sentiment(in_files(texts, str(tmp_path / "in"), "doc_id")), tmp_path, "text"), sentiment(texts))


def test_a_restarted_stream_goes_on_where_it_ended(spark, events, tmp_path):
    folder, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "bus"), str(tmp_path / "cp")
    for part in ("event_id < 400", "event_id >= 400"):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
        stream = fraud_detection(topics.read_stream(spark, topics.Topic(folder, events.schema)))
        assert sinks.finish(sinks.publish(stream, root, "restart", checkpoint), 120)
    got = spark.read.parquet(root)
    assert got.count() == events.count() == got.select("event_id").distinct().count()
    assert [r.batch for r in got.select("batch").distinct().orderBy("batch").collect()] == [0, 1]


def test_no_duplicates(spark, events, tmp_path):
    twice = events.unionByName(events)
    stream = windows.event_time(in_files(twice, str(tmp_path / "in"), "ts"), "ts", "1 day")
    assert run(windows.without_duplicates(stream, "event_id"), tmp_path, "dedup").count() == events.count()


def test_windowed_error_rate(spark, events, tmp_path):
    failed = F.col("event_type") == "error"
    stream = windows.event_time(in_files(events, str(tmp_path / "in"), "ts"), "ts", "0 seconds")
    got = run(windows.error_rate(stream, failed, "1 day"), tmp_path, "rates")
    whole = windows.error_rate(events.withColumn("ts", F.col("ts").cast("timestamp")), failed, "1 day")
    last = events.agg(F.date_trunc("DAY", F.max("ts"))).first()[0]
    same(got, whole.where(F.col("window_start") < F.lit(last)))


def test_session_batches(spark, tmp_path):
    at = [0, 30, 60, 400, 450, 2000, 999999]
    rows = [(1, START + timedelta(milliseconds=x)) for x in at]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    stream = windows.event_time(in_files(df, str(tmp_path / "in"), "ts", 2), "ts", "0 seconds")
    got = run(windows.session_batches(stream, "k"), tmp_path, "sessions")
    assert [r.n for r in got.orderBy("opened").collect()] == [3, 2, 1]


def test_fan_in_of_streams(spark, events, tmp_path):
    scores = events.select("event_id", (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"), (F.col("value") * 2).alias("score"))
    left = windows.event_time(in_files(events.select("event_id", "ts", "event_type"), str(tmp_path / "l"), "ts"))
    right = windows.event_time(in_files(scores, str(tmp_path / "r"), "ts"))
    got = run(windows.fan_in(left, right, "event_id", "1 MINUTE"), tmp_path, "fanin")
    expected = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") * 2).alias("score"))
    same(got, expected)


@pytest.mark.parametrize("ttl", [86400.0, None])
def test_throttle(spark, events, tmp_path, ttl):
    narrow = events.select("event_id", "user_id", "ts")
    stream = in_files(narrow, str(tmp_path / "in"), "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(state.throttle(stream, "user_id", ttl, tie=["event_id"]), tmp_path, "throttle")
    expected = batch_throttle(narrow, "user_id", "ts", F.date_trunc("DAY", "ts"), ttl, tie="event_id")
    same(got.select("event_id"), expected.select("event_id"))


def test_throttle_forgets_keys_that_no_longer_matter(spark, events, tmp_path):
    narrow = events.select("event_id", "user_id", "ts")
    stream = windows.event_time(in_files(narrow, str(tmp_path / "in"), "ts"), "ts", "0 seconds")
    got = run(state.throttle(stream, "user_id", 3600.0, tie=["event_id"], expire=True), tmp_path, "expire")
    expected = batch_throttle(narrow, "user_id", "ts", F.date_trunc("DAY", "ts"), 3600.0, tie="event_id")
    same(got.select("event_id"), expected.select("event_id"))
    kept = spark.read.format("statestore").option("path", str(tmp_path / "cp-expire")).option("stateVarName", "passed").load()
    last = events.agg(F.max("ts")).first()[0]
    assert kept.count() == expected.where(F.col("ts") >= F.lit(last - timedelta(hours=1))).select("user_id").distinct().count()


def test_memory(spark, data, tmp_path):
    turns = spark.read.parquet(f"{data}/conversations.parquet").withColumnRenamed("text", "content")
    stream = in_files(turns, str(tmp_path / "in"), "turn")
    got = run(state.memory(stream, "conv_id", "turn", size=3), tmp_path, "memory")
    kept = prompts.history(turns, ["conv_id"], [F.col("turn")], F.floor(F.col("turn") / 4), content="content", size=3)
    same(got, kept.select("conv_id", "turn", "history"))


def test_review_lifecycle(spark, data, tmp_path):
    """Ids are texts, and about half of the decisions come before their request, in earlier triggers too."""
    text_id = lambda column: F.concat(F.lit("order "), column)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select(
        text_id("l_orderkey").alias("review_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("reviewer"),
        F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("decision"),
        F.col("l_shipdate").alias("decided_at"),
        F.xxhash64("*").alias("tie"),
    )
    config = ReviewConfig(required_approvals=2, timeout_seconds=365 * 86400)
    orders = spark.read.parquet(f"{data}/orders.parquet")
    created = orders.select(text_id("o_orderkey").alias("review_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    opened = review.submit(created, F.col("review_id"), F.col("created_at"), F.lit("x"), config)
    expected = review.resolve(opened, lines, config, ["tie"])

    asked = created.select("review_id", F.lit("request").alias("kind"), F.col("created_at").alias("ts"))
    given = lines.select("review_id", F.lit("decision").alias("kind"), F.col("decided_at").alias("ts"), "reviewer", "decision", "tie")
    # A request far in the future moves the watermark past every deadline.
    flush = spark.createDataFrame([("flush", "request", datetime(2030, 1, 1))], "review_id string, kind string, ts timestamp_ntz")
    feed = given.unionByName(asked, allowMissingColumns=True).unionByName(flush, allowMissingColumns=True)
    stream = windows.event_time(in_files(feed, str(tmp_path / "in"), ["ts", "review_id"]), "ts", "1 day")
    got = run(state.reviews(stream, config, tie=["tie"]), tmp_path, "reviews").where("review_id <> 'flush'")

    closed = got.where(F.col("status").isin("approved", "rejected", "timed_out"))
    same(closed.select("review_id", "status"), expected.select("review_id", "status"))
    late = review.orphans(opened, lines, config, ["tie"])
    assert got.where("status = 'not_found'").count() == late.count()
    assert got.where("status = 'pending'").count() == created.count()


def test_open_reviews_can_be_looked_up(spark, tmp_path):
    rows = [(1, "request", None, None, 0), (2, "request", None, None, 0), (1, "decision", 7, "approved", 5), (2, "decision", 7, "approved", 6), (2, "decision", 8, "approved", 7)]
    feed = spark.createDataFrame(
        [(*r[:4], START + timedelta(seconds=r[4])) for r in rows], "review_id long, kind string, reviewer long, decision string, ts timestamp"
    )
    stream = windows.event_time(in_files(feed, str(tmp_path / "in"), "ts", 1), "ts", "1 day")
    config = ReviewConfig(required_approvals=2, timeout_seconds=3600)
    changes = run(state.reviews(stream, config), tmp_path, "open")
    assert {(r.review_id, r.status) for r in changes.collect()} == {(1, "pending"), (2, "pending"), (2, "approved")}
    waiting = state.open_reviews(spark, str(tmp_path / "cp-open")).collect()
    assert [(r.review_id, r.approvals, r.deadline) for r in waiting] == [(1, 1, START + timedelta(hours=1))]


def test_bounded_wait(spark, tmp_path):
    ticks = spark.readStream.format("rate").load()
    query = ticks.writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
    assert sinks.finish(query, 2) is False


def test_quantile_sketches_of_a_stream(spark, events, tmp_path):
    """Hourly sketches of a stream merge into the day's quantiles, each within its rank error."""
    hours = [START + timedelta(minutes=i % 1440) for i in range(30_000)]
    values = [float((i * 7919) % 30_011) for i in range(30_000)]
    rows = [*zip(hours, values), *[(START + timedelta(days=2), None)] * 3, (START + timedelta(days=9), 1.0)]
    source = in_files(spark.createDataFrame(rows, "ts timestamp, x double"), str(tmp_path / "in"), "ts")
    stream = windows.quantile_sketches(windows.event_time(source), F.col("x"), "1 hour", k=64)
    hourly = run(stream, tmp_path, "sketches")
    assert hourly.where("n = 0 AND sketch IS NULL").count() == 1 and hourly.where("n > 1000").count() == 24
    shares = [0.05, 0.5, 0.95]

    def check(sketches, held):
        found = sketches.where("n > 0").select("window_start", "n", *[windows.sketched_quantile(q).alias(f"q{q}") for q in shares])
        for row in found.collect():
            inside = sorted(held[row.window_start])
            assert row.n == len(inside)
            for q in shares:
                rank = sum(x <= row[f"q{q}"] for x in inside) / len(inside)
                assert abs(rank - q) <= 0.08
        return found.count()

    by_hour, by_day = {}, {}
    for at, x in zip(hours, values):
        by_hour.setdefault(at.replace(minute=0), []).append(x)
        by_day.setdefault(START, []).append(x)
    assert check(hourly, by_hour) == 24
    assert check(windows.merged_sketches(hourly, "1 day", k=64), by_day) == 1
    state_size = hourly.agg(F.max(F.length("sketch"))).head()[0]
    assert state_size < 64 * 8 * 8
