"""Catalogue checks and monitoring metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import checks, metrics
from eventflow.operators.ordered import previous
from eventflow.plans.registry import Tables, query
from eventflow.streaming import windows


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(t: Tables):
    return checks.count_by(t.events, "event_type")


@query("""
SELECT lang, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_sources
FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1
""")
def group_collect(t: Tables):
    lists = checks.distinct_lists(t.documents, "lang", "source")
    return lists.select("lang", F.array_join("items", ",").alias("sources"), F.size("items").cast("bigint").alias("n_sources"))


@query("""
SELECT name, count(*) AS n FROM (
  SELECT lang AS name FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT role FROM conversations
  UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)
GROUP BY 1 HAVING count(*) > 1
""")
def dup_names(t: Tables):
    named = [(t.documents, "lang"), (t.documents, "source"), (t.conversations, "role"), (t.customer, "c_name"), (t.supplier, "s_name")]
    return checks.duplicates(*[table.select(F.col(column).alias("name")) for table, column in named])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_ids(t: Tables):
    return checks.duplicates(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def missing_required(t: Tables):
    labelled = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), on="doc_id", how="left")
    return labelled.where(F.col("quality").isNull()).select("doc_id")


@query("""
SELECT event_id, event_type IN ('error', 'view', 'signup') AS blank FROM events
""")
def blank_text(t: Tables):
    kind = F.col("event_type")
    topic = F.when(kind == "view", "").when(kind == "signup", " \t ").when(kind != "error", kind)
    return t.events.select("event_id", checks.is_blank(topic).alias("blank"))


@query("""
SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS name_ok,
       regexp_matches(p_type, '^[A-Za-z_][A-Za-z0-9_]*$') AS type_ok, false AS number_ok
FROM part
""")
def identifier_check(t: Tables):
    return t.part.select(
        "p_partkey",
        checks.is_identifier(F.col("p_name")).alias("name_ok"),
        checks.is_identifier(F.col("p_type")).alias("type_ok"),
        checks.is_identifier(F.concat(F.col("p_size").cast("string"), "p_type")).alias("number_ok"),
    )


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderpriority <> '1-URGENT' THEN 'model is required' END
         WHEN 'F' THEN CASE WHEN o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM') THEN 'model_path or model_name is required' END END AS error
FROM orders
""")
def conditional_required(t: Tables):
    key = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "model")
        .when(F.col("o_orderpriority") == "2-HIGH", "model_path")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "model_name")
        .otherwise("temperature")
    )
    agents = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "llm").when(F.col("o_orderstatus") == "F", "mlmodel").otherwise("router").alias("kind"),
        F.create_map(key, F.lit("x")).alias("config"),
    )
    config = F.col("config")
    error = (
        F.when((F.col("kind") == "llm") & checks.lacks_any(config, ["model"]), "model is required")
        .when((F.col("kind") == "mlmodel") & checks.lacks_any(config, ["model_path", "model_name"]), "model_path or model_name is required")
    )
    return agents.select("o_orderkey", error.alias("error"))


@query("""
WITH e AS (SELECT c_nationkey AS scope, 'balance below -900' AS error FROM customer WHERE c_acctbal < -900
           UNION ALL SELECT c_nationkey, 'balance above 9900' FROM customer WHERE c_acctbal > 9900),
     k AS (SELECT scope, error, count(*) AS n FROM e GROUP BY 1, 2),
     l AS (SELECT scope, CAST(sum(n) AS BIGINT) AS error_count, string_agg(error || ' x' || n, '; ' ORDER BY error || ' x' || n) AS errors FROM k GROUP BY 1)
SELECT s.scope, l.scope IS NULL AS valid, coalesce(l.error_count, 0) AS error_count, coalesce(l.errors, '') AS errors
FROM (SELECT DISTINCT c_nationkey AS scope FROM customer) s LEFT JOIN l ON l.scope = s.scope
""")
def check_report(t: Tables):
    balance = F.col("c_acctbal")
    rules = {"balance below -900": balance < -900, "balance above 9900": balance > 9900}
    errors = checks.error_rows(t.customer, "c_nationkey", rules)
    done = checks.report(t.customer.select(F.col("c_nationkey").alias("scope")), errors)
    return done.select("scope", "valid", "error_count", F.array_join("errors", "; ").alias("errors"))


@query("""
SELECT c_custkey, c_name FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AFRICA')
""")
def exclude_set(t: Tables):
    excluded = t.nation.join(t.region.where("r_name = 'AFRICA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    names = excluded.select(F.col("n_nationkey").alias("c_nationkey"))
    return t.customer.join(names, on="c_nationkey", how="left_anti").select("c_custkey", "c_name")


@query("""
WITH g AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
                  epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS us FROM events)
SELECT day, count(*) AS n, round(avg(us / 1e6), 3) AS avg_seconds, round(max(us / 1e6), 3) AS max_seconds,
       round(quantile_cont(us / 1e6, 0.5), 3) AS p50, round(quantile_cont(us / 1e6, 0.95), 3) AS p95
FROM g WHERE us IS NOT NULL GROUP BY 1
""")
def metric_latency(t: Tables):
    day = F.date_trunc("DAY", "ts").cast("timestamp_ntz")
    events = previous(t.events.select("user_id", "ts"), ["user_id"], ["ts"], F.date_trunc("HOUR", "ts"), "ts", "before")
    seconds = metrics.seconds_between(F.col("before"), F.col("ts"))
    rows = metrics.latency(events.withColumn("day", day), ["day"], seconds)
    names = ["avg_seconds", "max_seconds", "p50", "p95"]
    return rows.select("day", "n", *[F.round(c, 3).alias(c) for c in names])


@query("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(value) AS n,
       quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95
FROM events WHERE value IS NOT NULL GROUP BY 1, 2
""")
def metric_sketches(t: Tables):
    # Hourly sketches, as a stream keeps them, merged into days; exact up to 2048 values a day and type.
    hours = windows.quantile_sketches(t.events, F.col("value"), "1 hour", ["event_type"])
    days = windows.merged_sketches(hours, "1 day", ["event_type"])
    p50, p95 = (windows.sketched_quantile(q).alias(n) for n, q in metrics.QUANTILES.items())
    return days.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", p50, p95)


@query("""
SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
       round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate
FROM events GROUP BY 1, 2
""")
def metric_error_rate(t: Tables):
    events = t.events.withColumn("day", F.date_trunc("DAY", "ts").cast("timestamp_ntz"))
    rates = metrics.error_rate(events, ["user_id", "day"], F.col("event_type") == "error")
    return rates.withColumn("error_rate", F.round("error_rate", 6))


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stddev,
       round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95
FROM events GROUP BY 1
""")
def metric_scores(t: Tables):
    rows = metrics.score_distribution(t.events, ["event_type"], F.col("value"))
    return rows.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "p50", "p95")])


@query("""
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, count(*) AS n, round(count(*) / 3600.0, 8) AS per_second
FROM events GROUP BY 1
""")
def metric_throughput(t: Tables):
    rows = metrics.throughput(t.events, "ts", 3600)
    return rows.select(F.col("window_start").cast("timestamp_ntz"), "n", F.round("per_second", 8).alias("per_second"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total,
       count(*) FILTER (o_orderstatus = 'F') * 100 // count(*) AS percent,
       count(*) FILTER (o_orderstatus = 'F') || '/' || count(*) || ' completed (' ||
         (count(*) FILTER (o_orderstatus = 'F') * 100 // count(*)) || '%)' AS progress
FROM orders GROUP BY 1
""")
def metric_progress(t: Tables):
    return metrics.progress(t.orders, ["o_orderpriority"], F.col("o_orderstatus") == "F")
