"""Human review in batch form: requests, decisions, outcomes, timeouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.sources.joins import skew_join

from .ordered import ranked

# States, default settings, topic parts.
PENDING, APPROVED, REJECTED, TIMED_OUT = "pending", "approved", "rejected", "timed_out"
CLOSED = (APPROVED, REJECTED, TIMED_OUT)
TOPIC_PART = {PENDING: "pending", APPROVED: "completed", REJECTED: "completed", TIMED_OUT: "timeout"}


@dataclass(frozen=True)
class ReviewConfig:
    required_approvals: int = 1
    timeout_seconds: int = 3600
    default_reviewers: tuple = ()
    require_all_reviewers: bool = False
    allow_self_approval: bool = False


def submit(df: DataFrame, review_id: Column, created_at: Column, item: Column, config: ReviewConfig) -> DataFrame:
    """Open a review per row. The id comes from the row, so reruns agree."""
    return df.select(
        review_id.alias("review_id"),
        F.lit(PENDING).alias("status"),
        item.alias("item"),
        created_at.alias("created_at"),
        F.lit(config.required_approvals).cast("bigint").alias("required_approvals"),
        F.lit(config.timeout_seconds).cast("bigint").alias("timeout_seconds"),
    )


def deadline(created_at: Column, timeout_seconds: Column) -> Column:
    return created_at + F.make_dt_interval(secs=timeout_seconds)


def allowed(decisions: DataFrame, config: ReviewConfig, submitter: str = "submitter") -> DataFrame:
    """Drop approvals by the submitter unless the settings allow them."""
    if config.allow_self_approval:
        return decisions
    own = (F.col("decision") == APPROVED) & F.col("reviewer").eqNullSafe(F.col(submitter))
    return decisions.where(~own)


def counts(decisions: DataFrame) -> DataFrame:
    """Approvals and rejections per review."""
    return decisions.groupBy("review_id").agg(
        F.count_if(F.col("decision") == APPROVED).alias("approvals"),
        F.count_if(F.col("decision") == REJECTED).alias("rejections"),
    )


def _order(tie: list[str]) -> Column:
    return F.struct("decided_at", *tie, "decision")


def _earliest_closing(decisions: DataFrame, needed: int, tie: list[str], chunk: Column | None) -> DataFrame:
    """The decision that would close each review if there were no deadline."""
    if needed <= 0:
        first = decisions.groupBy("review_id").agg(F.min(_order(tie)).alias("closing"))
        return first.withColumn("outcome", F.lit(APPROVED))
    final = decisions.where(F.col("decision").isin(APPROVED, REJECTED)).select("review_id", "decision", "decided_at", *tie)
    by_kind, order = ["review_id", "decision"], [F.col(c) for c in ("decided_at", *tie)]
    if chunk is None:
        w = Window.partitionBy(*by_kind).orderBy(*order)
        numbered = final.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= needed)
    else:
        numbered = ranked(final, by_kind, order, chunk, "__n")
    decisive = F.when(F.col("decision") == REJECTED, F.col("__n") == 1).otherwise(F.col("__n") == needed)
    earliest = F.min(F.struct(_order(tie).alias("closing"), F.col("decision").alias("outcome"))).alias("__first")
    return numbered.where(decisive).groupBy("review_id").agg(earliest).select("review_id", "__first.*")


def _once_each(decisions: DataFrame, config: ReviewConfig, tie: list[str]) -> DataFrame:
    """The first approval of each default reviewer, and everything that is no approval."""
    approving = F.col("decision") == APPROVED
    columns = list(dict.fromkeys(["review_id", "decision", "decided_at", "reviewer", *tie]))
    by_reviewer = decisions.where(approving & F.col("reviewer").isin(*config.default_reviewers))
    first = by_reviewer.groupBy("review_id", "reviewer").agg(F.min(_order(tie)).alias("__o")).select(
        *[F.col(c) if c in ("review_id", "reviewer") else F.col("__o")[c].alias(c) for c in columns]
    )
    return first.unionByName(decisions.where(~F.coalesce(approving, F.lit(False))).select(columns))


def closing_decisions(requests: DataFrame, decisions: DataFrame, config: ReviewConfig, tie: list[str], chunk: Column | None = None) -> DataFrame:
    """The decision that closes each review: ``review_id, outcome, closing``.

    Decisions from before the request do not count. The others count in the order of time, then the ``tie`` columns, which must
    tell a review's decisions apart. After each one, enough approvals close the
    review as approved, else any rejection closes it as rejected. So the n-th
    approval or the first rejection closes it, whichever is earlier: Spark trims
    each map task to n decisions of a kind per review. A large n takes a ``chunk``
    that never decreases in time, such as a day, to split a review's decisions.

    With ``require_all_reviewers`` only the default reviewers approve, each once,
    and all of them have to.
    """
    until = deadline(F.col("created_at"), F.col("timeout_seconds"))
    limits = requests.select("review_id", F.col("created_at").alias("__from"), until.alias("__until"))
    timely = skew_join(decisions, limits, ["review_id"]).where(F.col("decided_at").between(F.col("__from"), F.col("__until")))
    needed = config.required_approvals
    if config.require_all_reviewers and config.default_reviewers:
        timely, needed = _once_each(timely, config, tie), max(needed, len(set(config.default_reviewers)))
    return _earliest_closing(timely, needed, tie, chunk).select("review_id", "outcome", "closing")


def resolve(requests: DataFrame, decisions: DataFrame, config: ReviewConfig, tie: list[str], as_of: Column | None = None) -> DataFrame:
    """Status of every request, with ``closed_at`` for those a decision closed.

    Requests nothing closed have timed out, or are still pending if their
    deadline lies after ``as_of``.
    """
    closing = closing_decisions(requests, decisions, config, tie)
    joined = requests.drop("status").join(closing, on="review_id", how="left")
    until = deadline(F.col("created_at"), F.col("timeout_seconds"))
    rest = F.lit(TIMED_OUT) if as_of is None else F.when(until > as_of, PENDING).otherwise(TIMED_OUT)
    status = F.coalesce(F.col("outcome"), rest)
    return joined.withColumns({"status": status, "closed_at": F.col("closing.decided_at")}).drop("outcome", "closing")


def orphans(requests: DataFrame, decisions: DataFrame, config: ReviewConfig, tie: list[str]) -> DataFrame:
    """Decisions nobody waits for: no such review, not yet opened, already closed, or timed out."""
    closing = closing_decisions(requests, decisions, config, tie)
    until = deadline(F.col("created_at"), F.col("timeout_seconds"))
    known = requests.select("review_id", F.col("created_at").alias("__from"), until.alias("__until")).join(closing, on="review_id", how="left")
    joined = skew_join(decisions.withColumn("__order", _order(tie)), known, ["review_id"], "left")
    late = ~F.col("decided_at").between(F.col("__from"), F.col("__until")) | (F.col("__order") > F.col("closing"))
    missed = F.col("__until").isNull() | F.coalesce(late, F.lit(False))
    return joined.where(missed).select(*decisions.columns)


def still_open(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.col("status").isin(*CLOSED))


def topic(review_id: Column, status: Column) -> Column:
    """``reviews.<id>.pending``, ``.completed`` or ``.timeout``."""
    part = F.try_element_at(F.create_map(*[F.lit(x) for pair in TOPIC_PART.items() for x in pair]), status)
    return F.concat_ws(".", F.lit("reviews"), review_id.cast("string"), part)


def missing_reviewers(requests: DataFrame, decisions: DataFrame, config: ReviewConfig) -> DataFrame:
    """How many of the configured reviewers have not approved each request yet."""
    expected = list(config.default_reviewers)
    approving = decisions.where((F.col("decision") == APPROVED) & F.col("reviewer").isin(*expected))
    done = approving.groupBy("review_id").agg(F.countDistinct("reviewer").alias("__done"))
    joined = requests.join(done, on="review_id", how="left")
    open_ones = (F.lit(len(expected)) - F.coalesce("__done", F.lit(0))).cast("bigint")
    return joined.withColumn("missing", open_ones).drop("__done")


def on_timeout(resolved: DataFrame, action: str, escalation_topic: str) -> DataFrame:
    """What a timed-out review turns into: ``approve``, ``reject`` or ``escalate``."""
    is_late = F.col("status") == TIMED_OUT
    result = {"approve": APPROVED, "reject": REJECTED, "escalate": "escalated"}[action]
    where_to = F.lit(escalation_topic) if action == "escalate" else topic(F.col("review_id"), F.lit(result))
    return resolved.withColumns(
        {
            "final_status": F.when(is_late, result).otherwise(F.col("status")),
            "topic": F.when(is_late, where_to).otherwise(topic(F.col("review_id"), F.col("status"))),
        }
    )
