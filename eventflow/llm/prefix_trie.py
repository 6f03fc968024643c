"""The trie of conversation prefixes, by peeling: from the deepest turns up, equal sequences meet, lose their last turn and are regrouped.

A turn is the hash of its role and text, a prefix the hash of its turns. Equal
conversations become one class first. What a class shares with no other class, its tail,
is cut off in one step: such nodes form a plain chain. Above the tails, level by level
from the deepest, classes that end there join the nodes left over from the level below,
and each group of equal prefixes is a node, complete with the sums of its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm.common import text_of, written

#: Conversation ids that one piece of a list holds at most.
PIECE_IDS = 50_000
NO_IDS = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.sha256(b"root").digest()[:16]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, rank from 1 in the order of the turns (null first), hash, words.

    Null roles and texts count as empty; turns of one number are ordered by role and text,
    through their hashes. Rows without a conversation id belong to no conversation.
    """
    role, text = text_of(role_col), text_of(text_col)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), content.alias("hash"), words.alias("words")
    )
    in_order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "hash")
    return written(rows.withColumn("rank", F.row_number().over(in_order).cast("long")).drop("turn"), "trie-turns")


def with_shared_openings(rows: DataFrame, group: int, most: int) -> DataFrame:
    """Conversations rebuilt so that those of a group open alike.

    The first h turns of ``c - c % group`` replace the first h of ``c``, with h the CRC-32 of
    the decimal id modulo ``most``. Each conversation also gets a row of rank 0, so that one without turns stays.
    """
    h = F.crc32(F.col("conv").cast("string")) % most
    base = F.col("conv") - F.col("conv") % group
    # At most ``most - 1`` turns of each base, at most 2 * group - 1 conversations to a base.
    openings = rows.where((F.col("conv") % group == 0) & (F.col("rank") < most))
    openings = openings.select(F.col("conv").alias("base"), F.col("rank").alias("place"), F.col("hash").alias("h_"), F.col("words").alias("w_"))
    convs = rows.where("rank = 1").select("conv", h.alias("h"), base.alias("base"))
    opened = convs.join(openings, "base").where("place <= h").select("conv", F.lit(1).alias("part"), F.col("place").alias("rank"), F.col("h_").alias("hash"), F.col("w_").alias("words"))
    own = rows.where(F.col("rank") > h).select("conv", F.lit(2).alias("part"), "rank", "hash", "words")
    start = convs.select("conv", F.lit(0).alias("part"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("binary").alias("hash"), F.lit(0).cast("long").alias("words"))
    return start.unionByName(opened).unionByName(own)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and depth: conv, depth, key, words of the last turn, last (nothing follows).

    A conversation's hashes form a chain, so one task reads it, row by row; rows carry hashes, no texts.
    """
    ordered = rebuilt.repartition("conv").sortWithinPartitions("conv", "part", "rank")
    conv_type = rebuilt.schema["conv"].dataType.simpleString()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chain, depth = None, ROOT, 0
        names = ["conv", "depth", "key", "words", "last"]
        types = {}
        for batch in batches:
            out = []
            types["conv"] = batch.schema.field("conv").type
            for conv, part, content, words in zip(*[batch.column(c).to_pylist() for c in ("conv", "part", "hash", "words")]):
                if held is not None:
                    out.append((*held, part == 0))
                if part == 0:
                    chain, depth = ROOT, 0
                else:
                    chain, depth = hashlib.sha256(chain + content).digest()[:16], depth + 1
                held = (conv, depth, chain, words)
            yield _batch(out, names, types)
        if held is not None:
            yield _batch([(*held, True)], names, types)

    return written(ordered.mapInArrow(follow, f"conv {conv_type}, depth long, key binary, words long, last boolean"), "trie-prefixes")


def _batch(rows: list[tuple], names: list[str], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    fixed = {"depth": pa.int64(), "key": pa.binary(), "words": pa.int64(), "last": pa.bool_(), "piece": pa.int64(), "part": pa.int32(), "ids": pa.string(), "ids_sha256": pa.string()}
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n) or fixed[n]) for n, c in zip(names, columns)], names=names)


def hashed_lists(ends: DataFrame) -> DataFrame:
    """(key, ids_sha256): the SHA-256 of the ids of each key, ascending, comma-joined. ``ends`` has key and conv.

    Ids are sorted by a range shuffle, which splits a large key, and written as pieces of
    text; one task then reads a key's pieces in order, one at a time, since the digest is sequential.
    """
    ordered = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), ["key", "part", "piece", "ids"]
        key, ids, piece = None, [], 0
        for batch in batches:
            out = []
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (k != key or len(ids) == PIECE_IDS):
                    out.append((key, part, piece, ",".join(ids)))
                    ids, piece = [], piece + 1
                key = k
                ids.append(str(conv))
            yield _batch(out, names, {})
        if ids:
            yield _batch([(key, part, piece, ",".join(ids))], names, {})

    pieces = written(ordered.mapInArrow(join, "key binary, part int, piece long, ids string"), "trie-ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids")):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield _batch(out, ["key", "ids_sha256"], {})
        if state is not None:
            yield _batch([(key, state.hexdigest())], ["key", "ids_sha256"], {})

    by_key = pieces.repartition("key").sortWithinPartitions("key", "part", "piece")
    return by_key.mapInArrow(digest, "key binary, ids_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """The trie of ``prefixes``: one row per distinct prefix.

    Columns: conv_id (least member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. ``saved_tokens`` sums, over the
    subtree, the words of each last turn times the members beyond the first. The rounds
    are as many as the turns of the longest prefix that two different conversations share.
    An empty table has an empty result.
    """
    ends = rows.where("last")
    classes = ends.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("members"), F.first("depth").alias("end"))
    classes = written(classes.join(hashed_lists(ends), "key").drop("key"), "trie-classes")
    # Each class is followed through its least conversation only.
    paths = rows.join(classes, "conv").select("conv", "depth", "key", "words", "members", "ids_sha256", (F.col("depth") == F.col("end")).alias("last"))
    paths = written(paths, "trie-paths")
    shared = paths.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1").select("key")
    # Read back from a table, this side comes without a partitioning of its own, so a hot key of the other can be split.
    shared = written(shared, "trie-shared").withColumn("is_shared", F.lit(True))
    marked = paths.join(shared, "key", "left").withColumn("is_shared", F.coalesce("is_shared", F.lit(False)))
    marked = written(marked, "trie-marked")

    # Tails: chains of one class, summed from the end.
    tail = marked.where("NOT is_shared")
    from_end = Window.partitionBy("conv").orderBy(F.col("depth").desc())
    saved = F.sum((F.col("members") - 1) * F.col("words")).over(from_end)
    tail = written(tail.select("conv", "depth", "key", "members", saved.alias("saved"), F.when(F.col("last"), F.col("ids_sha256")).alias("ids_sha256"), "last"), "trie-tails")

    # What enters a level: classes that end there, and heads of tails that hang from it.
    body = marked.where("is_shared")
    spine = body.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "words"))).alias("path"), F.max("depth").alias("deepest"))
    own = body.where("last").select("conv", "members", "ids_sha256")
    head = tail.groupBy("conv").agg(F.max_by(F.struct("members", "saved"), F.struct(-F.col("depth"))).alias("head"))
    entering = spine.join(own, "conv", "left").join(head, "conv", "left").select(
        "conv",
        "path",
        F.col("deepest").alias("level"),
        F.coalesce("members", "head.members").alias("n_convs"),
        F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("n_children"),
        F.when(F.col("head").isNull(), 0).otherwise(1).cast("long").alias("n_leaves"),
        F.coalesce("head.saved", F.lit(0)).cast("long").alias("saved"),
        "ids_sha256",
    )
    entering = written(entering, "trie-entering")
    deepest = entering.agg(F.max("level")).first()[0]
    levels, left = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        now = entering.where(F.col("level") == level).drop("level")
        now = now if left is None else now.unionByName(left)
        left, found = _peel(now, level)
        levels.append(found)
    chains = tail.select(
        "key", "conv", "depth", F.col("members").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ids_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    found = chains
    for each in levels:
        found = found.unionByName(each.select(*chains.columns))
    # A node's parent: the conversation's key one level up leads to the least member there.
    least = found.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv_id"))
    up = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"))
    found = found.join(up, ["conv", "depth"], "left").join(least, "parent_key", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def _peel(now: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Groups what has come up to a level into nodes: (the nodes without their last turn, the nodes)."""
    last = F.col("path")[level]
    # Many children of one node are summed before the shuffle; the paths of a group are equal.
    grouped = now.groupBy(last["key"].alias("key")).agg(
        F.min("conv").alias("conv"),
        F.first("path").alias("path"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("below"),
        F.max("ids_sha256").alias("ids_sha256"),
    )
    words = F.col("path")[level]["words"]
    node = written(grouped.withColumn("saved", F.col("below") + (F.col("n_convs") - 1) * words), f"trie-level-{level}")
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    found = node.select(
        "key", "conv", F.lit(level).cast("long").alias("depth"), "n_convs", "n_children", leaves.alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ids_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long").alias("n_children")
    left = node.select("conv", F.slice("path", 1, level).alias("path"), "n_convs", one, leaves.alias("n_leaves"), "saved", F.lit(None).cast("string").alias("ids_sha256"))
    return left, found
