"""Time limits and redelivery: the rules by hand, the batch form, and the stream, also after a restart."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventflow.functions import json_text
from eventflow.operators import decide, flow
from eventflow.operators import redelivery as r
from eventflow.operators.redelivery import Policy
from eventflow.plans.queries.common import BODY, messages
from eventflow.sources import topics
from eventflow.streaming import redelivery as stream
from eventflow.streaming import sinks, windows

START = datetime(2024, 1, 1)
SCHEMA = "id long, kind string, ts timestamp, payload string"
S = 1_000_000


def statuses(events, policy):
    return [(o.status, o.attempt, o.at_us // S, o.reason) for o in r.follow([(at * S, kind, None) for at, kind in events], policy)]


def test_rules_by_hand():
    policy = Policy(timeout_seconds=10, retries=2, delay_seconds=5)
    assert statuses([(0, "request"), (10, "result")], policy) == [("ok", 1, 10, None)]
    assert statuses([(0, "request"), (11, "result")], policy) == [
        ("retry", 1, 10, "timed_out"), ("late", 1, 11, "result"), ("deliver", 2, 15, None), ("retry", 2, 25, "timed_out"),
        ("deliver", 3, 35, None), ("given_up", 3, 45, "timed_out"),
    ]
    assert statuses([(0, "request"), (2, "failure"), (7, "result")], policy) == [("retry", 1, 2, "failure"), ("deliver", 2, 7, None), ("ok", 2, 7, None)]
    assert statuses([(3, "result"), (4, "request"), (5, "request")], Policy(10)) == [("not_found", 0, 3, "result"), ("repeated", 1, 5, None), ("given_up", 1, 14, "timed_out")]


def random_events(seed, ids):
    rng = random.Random(seed)
    rows = []
    for i in range(ids):
        at = rng.randrange(3000)
        if rng.random() < 0.95:
            rows.append((i, "request", at))
        for _ in range(rng.randrange(6)):
            at += rng.choice([0, 1, 20, 60, 61, 90, 300])
            rows.append((i, rng.choice(["result", "failure", "failure", "request"]), at))
    rng.shuffle(rows)
    return [(i, kind, START + timedelta(seconds=at), f"{kind} {n}") for n, (i, kind, at) in enumerate(rows)]


def by_message(rows, policy):
    events = {}
    for i, kind, ts, payload in rows:
        events.setdefault(i, []).append((int((ts - START).total_seconds()) * S, r.KINDS.index(kind), payload, kind))
    found = [(i, o) for i, own in events.items() for o in r.follow([(at, kind, p) for at, _, p, kind in sorted(own)], policy)]
    rows = ((i, o.status, o.attempt, o.reason, o.payload, START + timedelta(microseconds=o.at_us)) for i, o in found)
    return sorted(rows, key=repr)


def collected(df):
    return sorted((tuple(x) for x in df.collect()), key=repr)


POLICY = Policy(timeout_seconds=60, retries=2, delay_seconds=30)


def test_batch_form(spark):
    rows = random_events(1, 300)
    assert collected(r.outcomes(spark.createDataFrame(rows, SCHEMA), POLICY)) == by_message(rows, POLICY)
    assert r.outcomes(spark.createDataFrame([], SCHEMA), POLICY).count() == 0


def run_stream(spark, feed, tmp_path, policy, parts=4, lateness="1 hour"):
    """The feed in ``parts`` files and a last event that moves the watermark past everything; the query is restarted half way."""
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    last = spark.createDataFrame([(datetime(2040, 1, 1),), (datetime(2041, 1, 1),)], "ts timestamp")
    flush = last.select(F.lit(None).cast(feed.schema["id"].dataType).alias("id"), F.lit("result").alias("kind"), "ts", F.lit("flush").alias("payload"))
    rows = feed.orderBy("ts").collect()
    step = -(-len(rows) // parts)
    files = [spark.createDataFrame(rows[i : i + step], feed.schema) for i in range(0, len(rows), step)]
    files += [flush.where("ts < '2040-06-01'"), flush.where("ts > '2040-06-01'")]
    for half in (files[: parts // 2], files[parts // 2 :]):
        for part in half:
            part.coalesce(1).write.mode("append").parquet(folder)
        read = windows.event_time(topics.read_stream(spark, topics.Topic(folder, feed.schema), batch_size=1), "ts", lateness)
        done = stream.outcomes(read, policy)
        assert sinks.finish(sinks.append(done, out, f"steps-{tmp_path.name}", cp), 200)
    return spark.read.schema(done.schema).parquet(out).where("payload IS NULL OR payload <> 'flush'")


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = random_events(2, 200)
    got = run_stream(spark, spark.createDataFrame(rows, SCHEMA), tmp_path, POLICY, lateness="2 hours")
    assert collected(got) == by_message(rows, POLICY)
    left = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "step").load()
    assert left.count() == 0


def test_stream_equals_step_timeout(spark, data, tmp_path):
    """Also for orders whose answer never comes."""
    orders = spark.read.parquet(f"{data}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"))
    lines = spark.read.parquet(f"{data}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("end"))
    lines = lines.join(orders, "id").where("end >= start")
    joined = orders.join(lines.select("id", "end"), "id", "left")
    assert joined.where("end IS NULL").count() > 0
    want = joined.select("id", flow.step_status(F.col("start"), F.col("end"), 60 * 86400).alias("status"))
    feed = orders.select("id", F.lit("request").alias("kind"), F.col("start").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("payload")).unionByName(
        lines.select("id", F.lit("result").alias("kind"), F.col("end").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("payload"))
    )
    got = run_stream(spark, feed, tmp_path, Policy(60 * 86400), parts=2, lateness="1 day").where("status <> 'not_found'")
    assert collected(got.select("id", F.when(F.col("status") == "ok", "ok").otherwise(F.col("reason")))) == collected(want)


def test_stream_equals_fallback_agent(spark, data, tmp_path):
    decoded = json_text.decode(messages(spark.read.parquet(f"{data}/events.parquet")), BODY)
    salvaged = F.regexp_extract("payload", "[0-9]+", 0).cast("bigint")
    want = flow.with_fallback(decoded.withColumn("k", F.col("body.k")), F.col("decode_error").isNotNull(), {"k": salvaged}).select("message_id", "k", "handled_by")
    at = F.col("ts").cast("timestamp")
    asked = decoded.select(F.col("message_id").alias("id"), F.lit("request").alias("kind"), at.alias("ts"), F.lit(None).cast("string").alias("payload"))
    kind = F.when(F.col("decode_error").isNull(), "result").otherwise("failure")
    answered = decoded.select(F.col("message_id").alias("id"), kind.alias("kind"), (at + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.coalesce(F.col("body.k").cast("string"), "payload").alias("payload"))
    got = run_stream(spark, asked.unionByName(answered), tmp_path, Policy(60), parts=2)
    handled = got.select("id", F.regexp_extract("payload", "[0-9]+", 0).cast("bigint").alias("k"), r.handled_by().alias("handled_by"))
    assert collected(handled) == collected(want)


def test_stream_equals_on_failure_route(spark, data, tmp_path):
    """A line that fails as often as its number says is set aside twice and then given up; others have their result at once."""
    lines = spark.read.parquet(f"{data}/lineitem.parquet").limit(1500).select("l_returnflag", "l_linenumber", F.monotonically_increasing_id().alias("id"))
    failing = F.col("l_returnflag") == "R"
    want = lines.select("id", decide.failure_route(failing, F.col("l_linenumber"), 2, "results", "quarantine", "alerts").alias("topic"))
    second = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") + n)
    no_text = F.lit(None).cast("string").alias("payload")
    asked = lines.select("id", F.lit("request").alias("kind"), second(F.lit(0)).alias("ts"), no_text)
    done = lines.where(~failing).select("id", F.lit("result").alias("kind"), second(F.lit(1)).alias("ts"), no_text)
    fails = lines.where(failing).select("id", F.explode(F.sequence(F.lit(1), F.least("l_linenumber", F.lit(3)))).alias("n"))
    fails = fails.select("id", F.lit("failure").alias("kind"), second(F.col("n") * 10).alias("ts"), no_text)
    got = run_stream(spark, asked.unionByName(done).unionByName(fails), tmp_path, Policy(timeout_seconds=1e6, retries=2), parts=2)
    # The last thing that the line's own events led to, without the time limit that ends an unanswered redelivery.
    own = got.where("status <> 'deliver' AND (reason IS NULL OR reason <> 'timed_out')").groupBy("id").agg(F.max_by("status", F.struct("at", "attempt")).alias("status"))
    assert collected(own.select("id", r.topic("results", "quarantine", "alerts").alias("topic"))) == collected(want)


@pytest.mark.parametrize("attempt", [1, 2, 3, 4])
def test_pauses_grow_to_a_limit(attempt):
    assert Policy(1, 9, 10, 3.0, 100).pause_us(attempt) == min(10 * 3 ** (attempt - 1), 100) * S
