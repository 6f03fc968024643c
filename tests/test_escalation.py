"""Escalation and reviewer policies: the rules by hand, and the stream against the batch forms, restarted half way."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventflow.operators import review
from eventflow.operators.review import ReviewConfig
from eventflow.sources import topics
from eventflow.streaming import escalation, sinks, windows
from eventflow.streaming.escalation import Escalation, Level, Rules

S = 1_000_000


def follow(events, config, chain):
    """(status, level, second) of each change; deadlines run out at the end."""
    rules, state, out = Rules(config, chain), None, []
    for at, kind, *who in events:
        if kind == "request":
            state = rules.request(1, state, at * S, who[0] if who else None, out)
        else:
            state = rules.decision(1, state, at * S, kind, who[0], out)
    rules.until(1, state, 1 << 62, out)
    return [(status, level, at // S) for status, level, at, *_ in out]


def test_levels_one_after_the_other():
    chain = Escalation((Level("leads", 100), Level("board", 1000)), last="reject")
    config = ReviewConfig(timeout_seconds=10)
    assert follow([(0, "request")], config, chain) == [("pending", 0, 0), ("escalated", 1, 10), ("escalated", 2, 110), ("rejected", 2, 1110)]
    assert follow([(0, "request"), (10, "approved", 1)], config, chain) == [("pending", 0, 0), ("approved", 0, 10)]
    assert follow([(0, "request"), (50, "approved", 1)], config, chain)[-1] == ("approved", 1, 50)
    assert follow([(0, "request"), (2000, "approved", 1)], config, chain)[-2:] == [("rejected", 2, 1110), ("not_found", 0, 2000)]


def test_policies():
    named = ReviewConfig(timeout_seconds=100, default_reviewers=(1, 2), require_all_reviewers=True)
    assert follow([(0, "request", 2), (1, "approved", 1), (2, "approved", 1), (3, "approved", 9), (4, "approved", 2)], named, Escalation()) == [
        ("pending", 0, 0), ("ignored", 0, 2), ("ignored", 0, 3), ("ignored", 0, 4), ("timed_out", 0, 100),
    ]
    allowed = ReviewConfig(timeout_seconds=100, default_reviewers=(1, 2), require_all_reviewers=True, allow_self_approval=True)
    assert follow([(0, "request", 2), (1, "approved", 1), (4, "approved", 2)], allowed, Escalation())[-1] == ("approved", 0, 4)


def tables(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select(
        F.col("l_orderkey").alias("review_id"),
        (F.col("l_suppkey") % 4).alias("reviewer"),
        F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("decision"),
        F.col("l_shipdate").alias("decided_at"),
        F.xxhash64("*").alias("tie"),
    )
    created = spark.read.parquet(f"{data}/orders.parquet").select(F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 4).alias("submitter"))
    return created, lines


def run(spark, created, lines, config, chain, tmp_path):
    asked = created.select("review_id", F.lit("request").alias("kind"), F.col("created_at").alias("ts"), "submitter")
    given = lines.select("review_id", F.lit("decision").alias("kind"), F.col("decided_at").alias("ts"), "reviewer", "decision", "tie")
    feed = asked.unionByName(given, allowMissingColumns=True)
    middle = F.lit(datetime(1995, 1, 1))
    flush = [spark.createDataFrame([(-1, "decision", datetime(year, 1, 1))], "review_id long, kind string, ts timestamp_ntz") for year in (2100, 2101)]
    files = [feed.where(F.col("ts") < middle), feed.where(F.col("ts") >= middle)]
    files += [f.unionByName(feed.limit(0), allowMissingColumns=True).select(feed.columns) for f in flush]
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for half in (files[:1], files[1:]):
        for part in half:
            part.orderBy("ts").coalesce(1).write.mode("append").parquet(folder)
        stream = windows.event_time(topics.read_stream(spark, topics.Topic(folder, feed.schema), batch_size=1), "ts", "1 day")
        changes = escalation.reviews(stream, config, chain, tie="tie")
        assert sinks.finish(sinks.append(changes, out, f"reviews-{tmp_path.name}", cp), 200)
    left = spark.read.format("statestore").option("path", cp).option("stateVarName", "review").load()
    assert left.count() == 0
    return spark.read.schema(changes.schema).parquet(out).where("review_id <> -1")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_equals_review_escalate(spark, data, tmp_path):
    created, lines = tables(spark, data)
    config = ReviewConfig(required_approvals=2, timeout_seconds=365 * 86400, allow_self_approval=True)
    opened = review.submit(created, F.col("review_id"), F.col("created_at"), F.lit("x"), config)
    resolved = review.resolve(opened, lines, config, ["tie"])
    want = review.on_timeout(resolved, "escalate", "escalations").select("review_id", "final_status", "topic")
    got = run(spark, created, lines, config, Escalation(last="escalate", last_topic="escalations"), tmp_path)
    same(got.where(F.col("status").isin("approved", "rejected", "escalated")).select("review_id", F.col("status").alias("final_status"), "topic"), want)
    assert got.where("status = 'not_found'").count() == review.orphans(opened, lines, config, ["tie"]).count()


@pytest.mark.parametrize("self_approval", [True, False])
def test_equals_the_batch_form_with_policies(spark, data, tmp_path, self_approval):
    created, lines = tables(spark, data)
    lines = lines.where("decision = 'approved'")
    config = ReviewConfig(timeout_seconds=20_000 * 86400, default_reviewers=(0, 1), require_all_reviewers=True, allow_self_approval=self_approval)
    # Approvals from before the request count in neither form here.
    given = lines.join(created, "review_id").where("decided_at >= created_at")
    counted = review.allowed(given, config).select(lines.columns)
    opened = review.submit(created, F.col("review_id"), F.col("created_at"), F.lit("x"), config)
    want = review.missing_reviewers(review.resolve(opened, counted, config, ["tie"]), counted, config)
    got = run(spark, created, given.select(lines.columns), config, Escalation(), tmp_path)
    same(got.where(F.col("status").isin("approved", "timed_out")).select("review_id", "status", "missing"), want.select("review_id", "status", "missing"))
