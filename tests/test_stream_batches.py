"""Micro-batches of a stream are those of the batch form: capped by size, closed by pauses, also after a restart."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventflow.operators.batches import micro_batches
from eventflow.sources import topics
from eventflow.streaming import batches, sinks, windows


def expected(events, size, idle):
    numbered = micro_batches(events, ["user_id"], "ts", ["ts", "event_id"], F.date_trunc("DAY", "ts"), size, idle)
    grouped = numbered.groupBy("user_id", "session", "batch").agg(
        F.count("*").alias("n"), F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("m")
    )
    return grouped.select("user_id", "session", "batch", "n", "opened", "closed", F.col("m.event_id").alias("items"))


@pytest.mark.parametrize(("size", "idle"), [(4, 6 * 3600.0), (32, 86_400.0 * 3)])
def test_equal_to_the_batch_form(spark, data, tmp_path, size, idle):
    events = spark.read.parquet(f"{data}/events.parquet").select(
        F.when(F.col("user_id") % 9 != 0, F.col("user_id") % 12).alias("user_id"), "event_id", F.date_trunc("HOUR", "ts").cast("timestamp").alias("ts")
    )
    want = expected(events, size, idle)
    # Rows of one file are in no order; the last two files move the watermark past everything.
    flush = [spark.createDataFrame([(-1, 0, datetime(year, 1, 1))], events.schema) for year in (2040, 2041)]
    days = [(1, 12), (12, 13), (13, 25), (25, 40)]
    files = [events.where(F.dayofmonth("ts").between(a, b - 1)).orderBy(F.xxhash64("event_id")) for a, b in days] + flush
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for half in (files[:3], files[3:]):
        for part in half:
            part.coalesce(1).write.mode("append").parquet(folder)
        read = windows.event_time(topics.read_stream(spark, topics.Topic(folder, events.schema), batch_size=1), "ts", "1 hour")
        found = batches.micro_batches(read, "user_id", "event_id", size=size, idle_seconds=idle)
        assert sinks.finish(sinks.append(found, out, f"batches-{size}", cp), 200)
    got = spark.read.schema(found.schema).parquet(out).where("user_id IS NULL OR user_id <> -1")
    assert sorted(map(repr, got.drop("closed_by").collect())) == sorted(map(repr, want.collect()))
    assert got.where(F.col("n") > size).isEmpty() and got.where((F.col("closed_by") == "size") != (F.col("n") == size)).isEmpty()
    assert {r.closed_by for r in got.select("closed_by").distinct().collect()} == {"size", "pause"}
