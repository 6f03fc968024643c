"""Versions valid at a time against brute force, and snapshots with a lifetime."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from eventflow.sources.versions import Snapshots, as_of

START = datetime(2024, 1, 1)


def hours(n):
    return START + timedelta(hours=n)


@pytest.mark.parametrize("ttl", [None, timedelta(hours=30)])
def test_as_of(spark, ttl):
    """A hot key, a NULL key, NULL times, ties, repeats and a column name of both tables."""
    draw = random.Random(4)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(i, draw.choice(keys), None if i % 50 == 0 else hours(draw.randrange(400)), f"row{i}") for i in range(600)]
    rows += rows[:20]
    versions = [(draw.choice(keys), None if i % 40 == 0 else hours(draw.randrange(400)), f"v{draw.randrange(90)}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, at timestamp, name string")
    known = spark.createDataFrame(versions, "k string, since timestamp, name string")
    found = as_of(df, known, ["k"], "at", "since", ttl=ttl)
    assert found.columns == [*df.columns, "version"]

    def best(key, at):
        fitting = [(s, n) for k, s, n in versions if key is not None and k == key and None not in (s, at) and s <= at]
        newest = max(fitting, default=None)
        return None if newest is None or (ttl is not None and at - newest[0] > ttl) else newest

    want = [(*r, best(r[1], r[2])) for r in rows]
    got = [(r.id, r.k, r.at, r.name, r.version and (r.version.since, r.version.name)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_as_of_empty_tables(spark):
    df, known = (spark.createDataFrame([], s) for s in ("k string, at timestamp", "k string, since timestamp, v int"))
    assert as_of(df, known, ["k"], "at", "since").count() == 0
    one = spark.createDataFrame([("a", START)], "k string, at timestamp")
    assert [r.version for r in as_of(one, known, ["k"], "at", "since").collect()] == [None]


def test_snapshots_in_a_stream(spark, tmp_path):
    """Each trigger refreshes the resource once its lifetime is over; a row meets the snapshot of its time."""
    now, loads = [datetime(2024, 1, 1, tzinfo=timezone.utc)], []

    def load():
        loads.append(now[0])
        return spark.createDataFrame([("a", f"load {len(loads)}")], "k string, rate string")

    held = Snapshots(spark, str(tmp_path / "held"), load, timedelta(hours=2))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def step(batch, number):
        now[0] = START.replace(tzinfo=timezone.utc) + timedelta(hours=int(number))
        held.refresh(now[0])
        held.lookup(batch, ["k"], "at").write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = [[("a", hours(-1)), ("a", hours(0)), ("b", hours(0))], [("a", hours(1))], [("a", hours(2))], [("a", hours(3)), ("a", hours(1))]]
    schema = "k string, at timestamp"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step)
        query = stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert len(loads) == 2 and not held.refresh(now[0])
    got = sorted(((r.k, r.at, r.rate) for r in spark.read.parquet(out).collect()), key=repr)
    want = [("a", hours(-1), None), ("a", hours(0), "load 1"), ("b", hours(0), None), ("a", hours(1), "load 1"), ("a", hours(2), "load 1")]
    want += [("a", hours(3), "load 2"), ("a", hours(1), "load 1")]
    assert got == sorted(want, key=repr)
    # Another driver finds the snapshots; a write that has not ended is none.
    (tmp_path / "held" / "data" / "snapshot=1").mkdir()
    again = Snapshots(spark, str(tmp_path / "held"), load, timedelta(hours=2))
    assert again.versions == held.versions and not again.refresh(now[0])
