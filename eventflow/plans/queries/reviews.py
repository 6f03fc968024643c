"""Reviews: one request per order, decisions from its line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventflow.operators import review
from eventflow.operators.flow import merge_back
from eventflow.operators.review import ReviewConfig
from eventflow.plans.registry import Tables, query

CONFIG = ReviewConfig(required_approvals=2, timeout_seconds=365 * 86400)

# Columns that tell the decisions of one review and day apart.
TIE = ["l_partkey", "reviewer", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]


def decisions(t: Tables):
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.col("l_orderkey").alias("review_id"),
        F.col("l_suppkey").alias("reviewer"),
        F.when(flag == "A", "approved").when(flag == "R", "rejected").otherwise("pending").alias("decision"),
        F.col("l_shipdate").alias("decided_at"),
        *[c for c in TIE if c != "reviewer"],
    )


def requests(t: Tables):
    """Opened at the order's date; about half of the lines shipped before it, so their decisions come too early."""
    ordered = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("created"))
    return review.submit(ordered, F.col("o_orderkey"), F.col("created"), F.col("o_orderkey"), CONFIG)


_ORDER = "decided_at, l_partkey, reviewer, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, decision"
_D_SQL = """
SELECT l_orderkey AS review_id, l_suppkey AS reviewer,
       CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS decision,
       l_shipdate AS decided_at, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
FROM lineitem
"""
_SQL = f"""
d AS ({_D_SQL}),
q AS (SELECT o_orderkey AS review_id, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders),
numbered AS (SELECT d.*, q.created_at, row_number() OVER (PARTITION BY d.review_id ORDER BY {_ORDER}) AS seq
             FROM d JOIN q ON q.review_id = d.review_id),
timely AS (SELECT *, sum(CASE WHEN decision = 'approved' THEN 1 ELSE 0 END) OVER w AS approvals,
                  sum(CASE WHEN decision = 'rejected' THEN 1 ELSE 0 END) OVER w AS rejections
           FROM numbered WHERE decided_at BETWEEN created_at AND created_at + INTERVAL 365 DAY
           WINDOW w AS (PARTITION BY review_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
closing AS (SELECT review_id, min(seq) AS seq FROM timely WHERE approvals >= 2 OR rejections > 0 GROUP BY 1),
resolved AS (
  SELECT q.review_id, q.created_at, c.seq, t.decided_at AS closed_at,
         CASE WHEN c.seq IS NULL THEN 'timed_out' WHEN t.approvals >= 2 THEN 'approved' ELSE 'rejected' END AS status
  FROM q LEFT JOIN closing c ON c.review_id = q.review_id LEFT JOIN timely t ON t.review_id = c.review_id AND t.seq = c.seq)
"""


@query("""
SELECT o_orderkey AS review_id, 'pending' AS status, o_orderstatus AS item, o_orderdate AS created_at,
       CAST(1 AS BIGINT) AS required_approvals, CAST(3600 AS BIGINT) AS timeout_seconds
FROM orders WHERE o_totalprice > 250000
""")
def review_submit(t: Tables):
    large = t.orders.where("o_totalprice > 250000")
    return review.submit(large, F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus"), ReviewConfig())


@query(f"WITH {_SQL} SELECT review_id, status, coalesce(closed_at, created_at + INTERVAL 365 DAY) AS ended_at FROM resolved")
def review_resolve(t: Tables):
    states = review.resolve(requests(t), decisions(t), CONFIG, TIE)
    until = review.deadline(F.col("created_at"), F.col("timeout_seconds"))
    return states.select("review_id", "status", F.coalesce("closed_at", until).alias("ended_at"))


@query(f"""
WITH {_SQL}
SELECT n.review_id, n.reviewer, n.decision, n.decided_at, n.l_partkey, n.l_linenumber
FROM numbered n JOIN resolved r ON r.review_id = n.review_id
WHERE n.seq > coalesce(r.seq, 9223372036854775807) OR n.decided_at NOT BETWEEN n.created_at AND n.created_at + INTERVAL 365 DAY
""")
def review_orphans(t: Tables):
    late = review.orphans(requests(t), decisions(t), CONFIG, TIE)
    return late.select("review_id", "reviewer", "decision", "decided_at", "l_partkey", "l_linenumber")


@query("""
SELECT l_orderkey AS review_id, count(*) FILTER (l_returnflag = 'A') AS approvals, count(*) FILTER (l_returnflag = 'R') AS rejections
FROM lineitem GROUP BY 1
""")
def review_counts(t: Tables):
    return review.counts(decisions(t))


@query(f"""
WITH {_SQL}
SELECT review_id, created_at FROM resolved WHERE status = 'timed_out' AND created_at + INTERVAL 365 DAY > TIMESTAMP '1997-01-01'
""")
def review_open(t: Tables):
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    states = review.resolve(requests(t), decisions(t), CONFIG, TIE, as_of=now)
    return review.still_open(states).select("review_id", "created_at")


@query(f"""
WITH {_SQL}
SELECT review_id, status, created_at + INTERVAL 365 DAY AS expired_at FROM resolved WHERE status = 'timed_out'
""")
def review_timeout(t: Tables):
    states = review.resolve(requests(t), decisions(t), CONFIG, TIE)
    until = review.deadline(F.col("created_at"), F.col("timeout_seconds"))
    return states.where(F.col("status") == review.TIMED_OUT).select("review_id", "status", until.alias("expired_at"))


@query(f"""
WITH {_SQL}
SELECT review_id, 'reviews.' || review_id || CASE status WHEN 'timed_out' THEN '.timeout' ELSE '.completed' END AS topic FROM resolved
""")
def review_topics(t: Tables):
    states = review.resolve(requests(t), decisions(t), CONFIG, TIE)
    return states.select("review_id", review.topic(F.col("review_id"), F.col("status")).alias("topic"))


@query("""
WITH d AS (SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem
           WHERE NOT (l_returnflag = 'A' AND l_suppkey = l_linenumber)),
     a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS done FROM d WHERE l_returnflag = 'A' AND l_suppkey IN (1, 2, 3) GROUP BY 1),
     q AS (SELECT o_orderkey AS l_orderkey FROM orders)
SELECT q.l_orderkey AS review_id, 3 - coalesce(a.done, 0) AS missing FROM q LEFT JOIN a ON a.l_orderkey = q.l_orderkey
""")
def review_policies(t: Tables):
    # The submitter of a line stands behind its line number.
    config = ReviewConfig(default_reviewers=(1, 2, 3), require_all_reviewers=True)
    given = review.allowed(decisions(t).withColumn("submitter", F.col("l_linenumber").cast("bigint")), config)
    return review.missing_reviewers(requests(t), given, config).select("review_id", "missing")


@query(f"""
WITH {_SQL}
SELECT review_id, CASE status WHEN 'timed_out' THEN 'escalated' ELSE status END AS final_status,
       CASE status WHEN 'timed_out' THEN 'escalations' ELSE 'reviews.' || review_id || '.completed' END AS topic
FROM resolved
""")
def review_escalate(t: Tables):
    states = review.resolve(requests(t), decisions(t), CONFIG, TIE)
    return review.on_timeout(states, "escalate", "escalations").select("review_id", "final_status", "topic")


@query(f"""
WITH {_SQL}
SELECT o_orderkey, CASE WHEN r.status IN ('approved', 'rejected') THEN r.status ELSE o_orderstatus END AS outcome
FROM orders LEFT JOIN resolved r ON r.review_id = o_orderkey
""")
def review_merge(t: Tables):
    states = review.resolve(requests(t), decisions(t), CONFIG, TIE)
    reviewed = states.where(F.col("status") != review.TIMED_OUT).select(
        F.col("review_id").alias("o_orderkey"), F.col("status").alias("outcome")
    )
    original = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("outcome"))
    return merge_back(original, reviewed, ["o_orderkey"], ["outcome"])
