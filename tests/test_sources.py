"""Topics, resources, timers, reference data and the custom source."""

import pytest
from pyspark.sql import functions as F

from eventflow.sources import context, custom, resources, timer, topics


def test_publish_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("1", "test payload", "test.subject"), ("2", "x", "other")], "message_id string, payload string, topic string")
    topics.write(df, str(tmp_path / "bus"), format="json")
    got = topics.read(spark, topics.Topic(str(tmp_path / "bus" / "topic=test.subject"), df.drop("topic").schema, "json"))
    assert [tuple(r) for r in got.collect()] == [("1", "test payload")]


def test_streams_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        topics.read_stream(spark, topics.Topic(str(tmp_path)))


def test_kafka_rows_become_messages_and_back(spark):
    rows = spark.sql(
        "SELECT cast('7' AS binary) AS key, cast('{}' AS binary) AS value, 'orders' AS topic, timestamp'2024-01-01' AS timestamp,"
        " array(named_struct('key', 'reply_to', 'value', cast('r' AS binary))) AS headers"
    )
    message = topics.from_kafka(rows)
    got = message.first()
    assert (got.message_id, got.subject, got.payload, got.reply_to, got.headers) == ("7", "orders", "{}", "r", {"reply_to": "r"})
    back = topics.to_kafka(message.withColumnRenamed("subject", "topic")).first()
    assert (bytes(back.key), bytes(back.value), back.topic, back.headers[0].key) == (b"7", b"{}", "orders", "reply_to")


def test_members_cover_everything_evenly(spark):
    df = spark.range(4000).select("id", topics.member_of_group(F.col("id"), 5).alias("m"))
    counts = {r.m: r["count"] for r in df.groupBy("m").count().collect()}
    assert set(counts) == set(range(5)) and min(counts.values()) > 600


def test_prefix_and_sizes(spark):
    df = spark.createDataFrame([("abc", "ä")], "s string, p string")
    row = df.select(topics.prefixed(F.col("s"), "p."), topics.prefixed(F.col("s"), ""), topics.within_size(F.col("p"), 1), topics.within_size(F.col("p"), 2)).first()
    assert list(row) == ["p.abc", "abc", False, True]


def test_reply_only_and_both(spark):
    df = spark.createDataFrame([(1, "r"), (2, None)], "id int, reply_to string")
    both = [(r.id, r.topic) for r in topics.reply_fan_out(df, "out").orderBy("id", "topic").collect()]
    assert both == [(1, "out"), (1, "r"), (2, "out")]
    assert [r.id for r in topics.reply_fan_out(df, None).collect()] == [1]


def test_resources(spark, tmp_path):
    path = f"file://{tmp_path}/a/b/data"
    resources.put(spark.range(3), path)
    assert resources.get(spark, path, format="parquet").count() == 3
    assert resources.get(spark, path).select("length").count() >= 1
    for uri in ("http://host/x", "ftp://host/x"):
        with pytest.raises(ValueError):
            resources.put(spark.range(1), uri)


def test_uri_dispatch(spark):
    uris = ["file:///x", "HTTPS://h/x", "ftp://h/x", "no scheme", None]
    df = spark.createDataFrame([(u,) for u in uris], "u string").select(resources.dispatch(F.col("u")).alias("d")).select("d.*")
    got = [tuple(r) for r in df.collect()]
    assert got == [
        ("file", True, True, None),
        ("https", True, False, None),
        ("ftp", False, False, "unsupported scheme: ftp"),
        (None, False, False, "invalid URI"),
        (None, False, False, "invalid URI"),
    ]


def test_ticks(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-01 05:00:00', timestamp_ntz'2024-01-03 00:30:00')) AS ts")
    got = sorted(str(r.tick) for r in timer.ticks(df, "ts", "INTERVAL '6' HOUR").collect())
    assert len(got) == 9 and got[0] == "2024-01-01 00:00:00" and got[-1] == "2024-01-03 00:00:00"
    got = sorted(str(r.tick) for r in timer.ticks(df, "ts", "INTERVAL '7' HOUR").collect())
    assert got[3:5] == ["2024-01-01 21:00:00", "2024-01-02 04:00:00"] and len(got) == 7
    assert [str(r.tick) for r in timer.ticks(df, "ts", "INTERVAL '36' HOUR").orderBy("tick").collect()][1] == "2024-01-02 12:00:00"
    assert timer.ticks(df, "ts", "INTERVAL '1' SECOND").count() == 48 * 3600 + 1800 + 1
    assert timer.ticks(df.limit(0), "ts", "INTERVAL '1' HOUR").count() == 0


def test_database_lookup_is_one_join(spark):
    orders = spark.createDataFrame([(1, 10), (2, 99)], "o int, cust int")
    table = spark.createDataFrame([(10, "x")], "id int, name string")
    rows = context.database_lookup(orders, table, {"id": "cust"}).orderBy("o").collect()
    assert [r.name for r in rows] == ["x", None]


def test_broadcast_only_below_the_limit(spark, data):
    small = spark.read.parquet(f"{data}/nation.parquet")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(context.sized(small))
    assert "broadcast" not in plan(context.sized(small, limit=10))


def test_context_text_holds_all_lines(spark):
    ref = spark.range(5).select("id", F.concat(F.lit("line "), "id").alias("t"))
    text = spark.range(1).select(context.context_text(ref, F.col("t"), "id"))
    assert text.first()[0] == "line 0\nline 1\nline 2\nline 3\nline 4"
    many = spark.range(10_050).select("id", F.col("id").cast("string").alias("t"))
    text = spark.range(1).select(context.context_text(many, F.col("t"), "id")).first()[0]
    assert text == "\n".join(map(str, range(10_050)))


def test_custom_source(spark, tmp_path):
    custom.register(spark, custom.TickSource)
    options = {"start": "2024-01-01T00:00:00", "seconds": 60, "count": 10, "parts": 3}
    rows = spark.read.format("ticks").options(**options).load().orderBy("tick_id").collect()
    assert [r.tick_id for r in rows] == list(range(10)) and rows[9].tick.minute == 9
    stream = spark.readStream.format("ticks").options(**options).load()
    query = stream.writeStream.format("memory").queryName("ticks_out").option("checkpointLocation", str(tmp_path)).trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("ticks_out").count() == 10


def test_a_new_member_takes_only_its_share(spark):
    ids = spark.range(20_000)
    group = {"a": 1.0, "b": 1.0, "c": 2.0}
    both = ids.select(topics.member_by_weight(F.col("id"), group).alias("x"), topics.member_by_weight(F.col("id"), {**group, "d": 1.0}).alias("y"))
    counts = {(r.x, r.y): r["count"] for r in both.groupBy("x", "y").count().collect()}
    assert all(x == y or y == "d" for x, y in counts)
    share = lambda test: sum(n for pair, n in counts.items() if test(*pair)) / 20_000
    assert abs(share(lambda x, y: y == "d") - 1 / 5) < 0.01
    assert abs(share(lambda x, y: x == "c") - 1 / 2) < 0.01 and abs(share(lambda x, y: x == "a") - 1 / 4) < 0.01
    alone = ids.select(topics.member_by_weight(F.col("id"), {"only": 3.0}).alias("x")).distinct().collect()
    assert [r.x for r in alone] == ["only"]
