"""Models: batch scoring, thresholds, anomalies, networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventflow.operators import bayes, inference, score
from eventflow.operators.batches import micro_batches as in_batches
from eventflow.plans.registry import Tables, query


def load_risk_model():
    """A stand-in for a trained model: risk from value and hour of day."""

    def predict(rows: np.ndarray) -> np.ndarray:
        return 0.004 * rows[:, 0] + 0.01 * rows[:, 1]

    return predict


def load_strict_model():
    """The same, but it refuses batches with an out-of-range value."""
    plain = load_risk_model()

    def predict(rows: np.ndarray) -> np.ndarray:
        if (rows[:, 0] > 200).any():
            raise ValueError("value out of range")
        return plain(rows)

    return predict


def scored(t: Tables):
    inputs = t.events.select("event_id", "event_type", score.feature_vector(F.col("value"), F.hour("ts")).alias("x"))
    return score.score(inputs, "x", 2, load_risk_model, batch_size=1024)


_SCORE = "0.004 * value + 0.01 * hour(ts)"


@query(f"SELECT event_id, round({_SCORE}, 6) AS prediction FROM events")
def ml_score(t: Tables):
    return scored(t).select("event_id", F.round("prediction", 6).alias("prediction"))


@query("""
WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     s AS (SELECT event_id, user_id, ts, CAST(sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g),
     p AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS position FROM s)
SELECT event_id, user_id, session, position, (position - 1) // 3 AS batch FROM p
""")
def micro_batches(t: Tables):
    events = t.events.select("event_id", "user_id", "ts")
    batched = in_batches(
        events, ["user_id"], "ts", ["ts", "event_id"], F.date_trunc("HOUR", "ts"), size=3, idle_seconds=6 * 3600
    )
    return batched.select("event_id", "user_id", "session", "position", "batch")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(3 AS BIGINT) AS width, l_quantity AS first, l_discount AS second, l_tax AS third
FROM lineitem
""")
def feature_vector(t: Tables):
    vector = score.feature_vector(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", vector.alias("x"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.size("x").cast("bigint").alias("width"),
        F.col("x")[0].alias("first"),
        F.col("x")[1].alias("second"),
        F.col("x")[2].alias("third"),
    )


@query(f"SELECT CAST(event_id AS VARCHAR) AS input_id, round({_SCORE}, 6) AS prediction, event_type AS origin FROM events")
def ml_format(t: Tables):
    metadata = F.create_map(F.lit("origin"), F.col("event_type"))
    result = score.as_result(F.col("prediction"), F.col("event_id").cast("string"), metadata)
    return scored(t).select(result.alias("r")).select(
        "r.input_id", F.round("r.prediction", 6).alias("prediction"), F.col("r.metadata")["origin"].alias("origin")
    )


@query(f"""
SELECT event_id, CASE WHEN value <= 200 THEN round({_SCORE}, 6) ELSE -1 END AS prediction,
       CASE WHEN value > 200 THEN 'Batch processing error: value out of range' END AS error,
       CASE WHEN value > 200 THEN 'risk' END AS agent
FROM events
""")
def ml_error_split(t: Tables):
    inputs = t.events.select("event_id", score.feature_vector(F.col("value"), F.hour("ts")).alias("x"))
    done = score.score_or_error(inputs, "x", load_strict_model, max_retries=1)
    record = score.error_record("risk", F.col("error"), F.lit("2024-01-01T00:00:00Z"))
    return done.select(
        "event_id",
        F.round(F.coalesce("prediction", F.lit(-1.0)), 6).alias("prediction"),
        F.get_json_object(record, "$.error").alias("error"),
        F.get_json_object(record, "$.agent").alias("agent"),
    )


@query(f"SELECT event_id, round({_SCORE}, 6) >= 0.5 AS flagged FROM events")
def ml_threshold(t: Tables):
    return scored(t).select("event_id", score.flagged(F.round("prediction", 6), 0.5).alias("flagged"))


@query("""
WITH m AS (SELECT o_orderpriority, median(o_totalprice) AS med FROM orders GROUP BY 1),
     a AS (SELECT o.o_orderpriority, median(abs(o.o_totalprice - m.med)) AS mad
           FROM orders o JOIN m ON m.o_orderpriority = o.o_orderpriority GROUP BY 1)
SELECT o.o_orderkey, round(abs(o.o_totalprice - m.med) / a.mad, 4) AS z
FROM orders o JOIN m ON m.o_orderpriority = o.o_orderpriority JOIN a ON a.o_orderpriority = o.o_orderpriority
""")
def anomaly_zscore(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return score.robust_zscore(orders, ["o_orderpriority"], "o_totalprice").select("o_orderkey", F.round("z", 4).alias("z"))


@query("""
WITH c AS (SELECT p_brand AS name, p_size || '.' || length(p_name) AS version, p_partkey AS file, p_size, length(p_name) AS minor FROM part)
SELECT name, version, file FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_size DESC, minor DESC, file DESC) AS n FROM c) WHERE n = 1
""")
def model_resolve(t: Tables):
    version = F.concat_ws(".", F.col("p_size").cast("string"), F.length("p_name").cast("string"))
    catalogue = t.part.select(F.col("p_brand").alias("name"), version.alias("version"), F.col("p_partkey").alias("file"))
    return score.latest_models(catalogue, "file")


WEIGHTS = [(i % 7 - 3) / 10 for i in range(64)]


@query(f"""
SELECT vec_id, round(1 / (1 + exp(-(0.25 + list_dot_product(CAST(embedding AS DOUBLE[]), CAST({WEIGHTS} AS DOUBLE[]))))), 6) AS p
FROM embeddings
""")
def ml_linear(t: Tables):
    p = score.logistic(score.linear(F.col("embedding"), WEIGHTS, bias=0.25))
    return t.embeddings.select("vec_id", F.round(p, 6).alias("p"))


@query("""
WITH f AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
     pt AS (SELECT toxic, (count(*) + 1.0) AS n FROM f GROUP BY 1),
     p0 AS (SELECT toxic, n / sum(n) OVER () AS p FROM pt),
     lt AS (SELECT toxic, lang, (count(*) + 1.0) AS n FROM f GROUP BY 1, 2),
     p1 AS (SELECT toxic, lang, n / sum(n) OVER (PARTITION BY toxic) AS p FROM lt),
     qt AS (SELECT toxic, quality, (count(*) + 1.0) AS n FROM f GROUP BY 1, 2),
     p2 AS (SELECT toxic, quality, n / sum(n) OVER (PARTITION BY toxic) AS p FROM qt),
     j AS (SELECT p0.toxic, p1.lang, p2.quality, p0.p * p1.p * p2.p AS p
           FROM p0 JOIN p1 ON p1.toxic = p0.toxic JOIN p2 ON p2.toxic = p0.toxic),
     n AS (SELECT *, p / sum(p) OVER (PARTITION BY lang, quality) AS post FROM j)
SELECT f.doc_id, n.toxic AS toxic_value, round(n.post, 6) AS p FROM f LEFT JOIN n ON n.lang = f.lang AND n.quality = f.quality
""")
def bayes_posterior(t: Tables):
    facts = t.documents.select("doc_id", "lang").join(t.labels, on="doc_id")
    joint = bayes.counts(facts, ["toxic", "lang", "quality"])
    factors = [
        bayes.prior(joint, "toxic"),
        bayes.conditional(joint, "lang", ["toxic"]),
        bayes.conditional(joint, "quality", ["toxic"]),
    ]
    network = bayes.posterior(factors, "toxic", ["lang", "quality"]).withColumnRenamed("toxic", "toxic_value")
    judged = bayes.infer(facts.select("doc_id", "lang", "quality"), network, ["lang", "quality"])
    return judged.select("doc_id", "toxic_value", F.round("p", 6).alias("p"))


@query("""
WITH f AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_quantity > 25 AS large, l_discount > 0.05 AS cheap, l_tax > 0.04 AS taxed FROM lineitem),
     p0 AS (SELECT flag, n / sum(n) OVER () AS p FROM (SELECT flag, count(*) + 1.0 AS n FROM f GROUP BY 1)),
     p1 AS (SELECT flag, status, n / sum(n) OVER (PARTITION BY flag) AS p FROM (SELECT flag, status, count(*) + 1.0 AS n FROM f GROUP BY 1, 2)),
     p2 AS (SELECT flag, large, n / sum(n) OVER (PARTITION BY flag) AS p FROM (SELECT flag, large, count(*) + 1.0 AS n FROM f GROUP BY 1, 2)),
     p3 AS (SELECT status, large, cheap, n / sum(n) OVER (PARTITION BY status, large) AS p
            FROM (SELECT status, large, cheap, count(*) + 1.0 AS n FROM f GROUP BY 1, 2, 3)),
     p4 AS (SELECT cheap, taxed, n / sum(n) OVER (PARTITION BY cheap) AS p FROM (SELECT cheap, taxed, count(*) + 1.0 AS n FROM f GROUP BY 1, 2)),
     j AS (SELECT flag, status, large, cheap, taxed, p0.p * p1.p * p2.p * p3.p * p4.p AS p
           FROM p0 JOIN p1 USING (flag) JOIN p2 USING (flag) JOIN p3 USING (status, large) JOIN p4 USING (cheap)),
     rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS status, CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity > 25 END AS large,
                     CASE WHEN l_partkey % 5 <> 0 THEN l_tax > 0.04 END AS taxed FROM lineitem),
     asked AS (SELECT DISTINCT status, large, taxed FROM rows),
     s AS (SELECT a.status, a.large, a.taxed, j.flag, sum(j.p) AS p FROM asked a JOIN j
            ON (a.status IS NULL OR a.status = j.status) AND (a.large IS NULL OR a.large = j.large) AND (a.taxed IS NULL OR a.taxed = j.taxed)
           GROUP BY ALL),
     post AS (SELECT *, p / sum(p) OVER (PARTITION BY status, large, taxed) AS post FROM s)
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, p.flag, round(p.post, 6) AS p
FROM rows r JOIN post p ON p.status IS NOT DISTINCT FROM r.status AND p.large IS NOT DISTINCT FROM r.large AND p.taxed IS NOT DISTINCT FROM r.taxed
""")
def bayes_missing_evidence(t: Tables):
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        (F.col("l_quantity") > 25).alias("large"), (F.col("l_discount") > 0.05).alias("cheap"), (F.col("l_tax") > 0.04).alias("taxed"),
    )
    joint = bayes.counts(lines, ["flag", "status", "large", "cheap", "taxed"])
    parents = {"flag": [], "status": ["flag"], "large": ["flag"], "cheap": ["status", "large"], "taxed": ["cheap"]}
    net = inference.network({name: (given, bayes.conditional(joint, name, given)) for name, given in parents.items()})
    known = {"status": F.col("l_linenumber") % 3 != 0, "large": F.col("l_suppkey") % 4 != 0, "taxed": F.col("l_partkey") % 5 != 0}
    rows = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.when(test, F.col(c)).alias(c) for c, test in known.items()])
    judged = inference.infer(rows, net, "flag", list(known), into="flag")
    return judged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag", F.round("p", 6).alias("p"))


@query(r"""
WITH w AS (SELECT conv_id, turn, role, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS words FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) AS overlap
FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE b.role = 'assistant'
""")
def validity_score(t: Tables):
    asked = t.conversations.select("conv_id", "turn", F.col("text").alias("input"))
    answers = t.conversations.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    pairs = asked.join(answers, on=["conv_id", "turn"])
    overlap = score.token_overlap(F.col("input"), F.col("output"))
    return pairs.select("conv_id", "turn", F.round(overlap, 6).alias("overlap"))
