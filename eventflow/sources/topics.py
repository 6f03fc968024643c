"""Topics as append-only folders or Kafka topics, and the message envelope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.functions.arrays import pick

ENVELOPE = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("reply_to", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Topic:
    """One topic: a folder (json, parquet, text, ..) or, with ``format="kafka"``, a topic name."""

    path: str
    schema: T.StructType | None = None
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)


def _reader(reader, topic: Topic):
    reader = reader.format(topic.format).options(**topic.options)
    if topic.format == "kafka":
        return reader.option("subscribe", topic.path).load()
    if topic.schema is not None:
        reader = reader.schema(topic.schema)
    return reader.load(topic.path)


def read(spark: SparkSession, topic: Topic) -> DataFrame:
    """All messages of a topic so far."""
    return _reader(spark.read, topic)


def read_stream(spark: SparkSession, topic: Topic, batch_size: int | None = None) -> DataFrame:
    """The topic as a stream; ``batch_size`` bounds the files or offsets of one trigger."""
    if topic.schema is None and topic.format != "kafka":
        raise ValueError("a streamed folder needs an explicit schema")
    options = dict(topic.options)
    if batch_size is not None:
        name = "maxOffsetsPerTrigger" if topic.format == "kafka" else "maxFilesPerTrigger"
        options[name] = str(batch_size)
    return _reader(spark.readStream, Topic(topic.path, topic.schema, topic.format, options))


def from_kafka(df: DataFrame) -> DataFrame:
    """The rows of a ``kafka`` source (read with ``includeHeaders``) as messages."""
    texts = F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string")))
    headers = F.map_from_entries(texts)
    return envelope(
        df,
        message_id=F.col("key").cast("string"),
        subject=F.col("topic"),
        payload=F.col("value").cast("string"),
        ts=F.col("timestamp"),
        reply_to=F.try_element_at(headers, F.lit("reply_to")),
        headers=headers,
    )


def to_kafka(df: DataFrame) -> DataFrame:
    """Rows with a ``topic`` in the shape a ``kafka`` sink takes."""
    entries = F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"], e["value"].cast("binary").alias("value")))
    return df.select(
        F.col("message_id").cast("binary").alias("key"),
        F.col("payload").cast("binary").alias("value"),
        "topic",
        entries.alias("headers"),
    )


def write(df: DataFrame, root: str, format: str = "parquet", mode: str = "append") -> None:
    """Publish rows that carry a ``topic`` column: one folder per topic, one pass."""
    df.write.format(format).mode(mode).partitionBy("topic").save(root)


def envelope(
    df: DataFrame,
    message_id: Column,
    subject: Column,
    payload: Column,
    ts: Column,
    reply_to: Column | None = None,
    headers: Column | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """Wrap rows as messages; ``keep`` names columns to carry along beside the payload."""
    text_map = "map<string,string>"
    return df.select(
        message_id.cast("string").alias("message_id"),
        subject.alias("subject"),
        payload.alias("payload"),
        (F.lit(None) if headers is None else headers).cast(text_map).alias("headers"),
        (F.lit(None) if reply_to is None else reply_to).cast("string").alias("reply_to"),
        ts.alias("ts"),
        *keep,
    )


def prefixed(subject: Column, prefix: str) -> Column:
    """The subject under a configured prefix; an empty prefix changes nothing."""
    return F.concat(F.lit(prefix), subject) if prefix else subject


def header(name: str, headers: str = "headers") -> Column:
    return F.try_element_at(F.col(headers), F.lit(name))


def member_of_group(key: Column, members: int) -> Column:
    """Queue group: the one member (0 .. members-1) that receives the message.

    Taken from a digest of the message id, so a busy sender is still spread
    evenly and a rerun delivers every message to the same member.
    """
    digest = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(digest, F.lit(members)).cast("bigint")


def member_by_weight(key: Column, members: dict[str, float]) -> Column:
    """Queue group whose members come and go: the name of the member that receives the message.

    Each member draws a number from the digest of its name and the message id, scaled by
    its weight, and the highest draw wins (rendezvous hashing). A member that joins takes its share
    from all others and none moves between them; one that leaves hands its share to the rest.
    """
    if not members or min(members.values()) <= 0:
        raise ValueError("a group has members, each with a positive weight")

    def draw(name: str, weight: float) -> Column:
        digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}/"), key.cast("string"))), 1, 12), 16, 10).cast("double")
        # -log of a uniform draw, over the weight: the least wins in proportion to the weights.
        return F.struct((-F.log((digest + 1) / float(1 << 48)) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name"))

    draws = [draw(name, weight) for name, weight in sorted(members.items())]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["name"]


def fan_out(df: DataFrame, subscribers: list[str], into: str = "subscriber") -> DataFrame:
    """Every subscriber gets every message: a narrow explode, no join."""
    return df.withColumn(into, F.explode(F.array(*[F.lit(s) for s in subscribers])))


def reply_fan_out(df: DataFrame, output_topic: str | None, reply_to: str = "reply_to") -> DataFrame:
    """Send each result to the output topic and to ``reply_to`` where present."""
    targets = [(F.col(reply_to).isNotNull(), F.col(reply_to))]
    if output_topic is not None:
        targets.insert(0, (F.lit(True), F.lit(output_topic)))
    return df.withColumn("topic", F.explode(pick(targets, "string")))


def merge(*sources: DataFrame) -> DataFrame:
    """Several sources as one; columns a source lacks are NULL."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def replay_from(df: DataFrame, start: str, ts: str = "ts") -> DataFrame:
    """Messages from a point in time on; the filter reaches the scan."""
    return df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))


def within_size(payload: Column, limit: int = 10 * 1024 * 1024) -> Column:
    """True where the payload is no larger than ``limit`` bytes."""
    return F.octet_length(payload) <= F.lit(limit)
