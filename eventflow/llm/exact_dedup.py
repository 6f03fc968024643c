"""Exact deduplication against a persistent digest index.

The index is a Parquet table in buckets, each sorted by digest. A batch is reduced to
one entry per digest, compared with the index by a sort-merge anti-join for which the
index is not shuffled, and what is new is appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventflow.llm.common import fresh, text_of, written

#: A digest with more than one row in this many is joined by broadcast: at most so many digests.
HEAVY = 1000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digest_of(text_col: str) -> Column:
    """SHA-256 of the normalised text in UTF-8; null texts count as empty."""
    return F.unhex(F.sha2(F.encode(normalised(text_of(text_col)), "UTF-8"), 256))


class DigestIndex:
    """Digests seen so far: digest, keep_id, group_size and the batch that brought them.

    ``path`` must be on storage all executors share. The same path and bucket count
    open the same index again, also from another session.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the groups (digest, keep_id, group_size) the index lacks. Repeating a batch adds nothing."""
        known = self.entries().select("digest").hint("merge")
        new = groups.join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        # One file per bucket and batch; the commit is the job's, so a failed append leaves nothing.
        new.repartition(self.buckets, "digest").select("digest", "keep_id", "group_size", "batch").write.insertInto(self.name)


def decide(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the batch to the index and returns a row per row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Of equal texts new to the index, the row with the smallest id is kept; texts an
    earlier batch held are all dropped, with that batch's keep_id and group_size. Null
    texts count as empty. A null id counts as larger than any other; of several rows
    with the same id and text one is kept. An empty table has an empty result.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(groups, "digest-groups")
    index.append(groups, batch)
    entries = index.entries()
    heavy = groups.where(F.col("group_size") * HEAVY > rows.count()).select("digest")
    # Repeats of one row meet here, by id and digest, so that no frequent text gathers in a task.
    copies = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    copies = written(copies, "digest-copies")
    light = copies.join(F.broadcast(heavy), "digest", "left_anti").join(entries, "digest")
    few = entries.join(F.broadcast(heavy), "digest", "left_semi")
    joined = light.unionByName(copies.join(F.broadcast(few), "digest"))
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def deduplicated(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, with all their columns.

    Null and empty texts are one text. Of repeated rows (same id and text) one stays; a null id
    counts as larger than any other. An empty table has an empty result.
    """
    keep = decide(docs, index, batch, id_col, text_col).where("kept")
    digest, row = fresh("digest", docs.columns), fresh("row", docs.columns)
    keep = keep.select(F.col("doc_id").alias("keep_doc_id"), F.col("digest").alias("keep_digest"))
    hashed = docs.withColumn(digest, digest_of(text_col))
    same = (hashed[digest] == keep["keep_digest"]) & hashed[id_col].eqNullSafe(keep["keep_doc_id"])
    one = Window.partitionBy(digest, id_col).orderBy(digest)
    found = hashed.join(keep, same, "left_semi").withColumn(row, F.row_number().over(one))
    return found.where(F.col(row) == 1).select(*[found[c] for c in docs.columns])
