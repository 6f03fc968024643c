"""Messages derived from the ``events`` table, for queries about payloads.

Error events carry a payload that was cut off, so JSON decoding has bad rows;
purchases ask for a reply; sign-ups carry no value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.sources.topics import envelope

BODY = T.StructType([T.StructField("k", T.LongType())])


def messages(events: DataFrame, *keep: str) -> DataFrame:
    kind = F.col("event_type")
    return envelope(
        events,
        message_id=F.col("event_id"),
        subject=F.concat(F.lit("events."), kind),
        payload=F.when(kind == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")),
        ts=F.col("ts"),
        reply_to=F.when(kind == "purchase", F.concat(F.lit("replies."), F.col("user_id").cast("string"))),
        headers=F.create_map(F.lit("type"), kind, F.lit("user"), F.col("user_id").cast("string")),
        keep=keep,
    )


MESSAGES_SQL = """
    SELECT CAST(event_id AS VARCHAR) AS message_id, 'events.' || event_type AS subject,
           CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END AS payload,
           CASE WHEN event_type = 'purchase' THEN 'replies.' || user_id END AS reply_to, ts
    FROM events
"""


def partial_events(events: DataFrame) -> DataFrame:
    """Events where sign-ups have no value and errors have no type."""
    return events.withColumns(
        {
            "value": F.when(F.col("event_type") != "signup", F.col("value")),
            "kind": F.nullif(F.col("event_type"), F.lit("error")),
        }
    )


PARTIAL_SQL = """
    SELECT event_id, ts, user_id, event_type, props,
           CASE WHEN event_type <> 'signup' THEN value END AS value,
           nullif(event_type, 'error') AS kind
    FROM events
"""
