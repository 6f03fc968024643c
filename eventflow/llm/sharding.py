"""Dealing rows into shards of near equal bytes by sampled splitters, with DataFrame operations only.

A sample drawn in proportion to size gives splitters at its quantiles; rows go to the
range between two splitters. Ranges that turn out overfull are subdivided by a second
hash, and whole ranges, in order, fill the shards. The sort key is a hash of the text,
then one of the row, so equal texts are neighbours and a text that fills many ranges
is split like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventflow.llm.common import text_of, written

#: Ranges of each shard at least; a shard misses its share by about one range at most.
RANGES_PER_SHARD = 256
#: Rows of a range that one task numbers, and the most ranges, which bounds the tables that are broadcast.
RANGE_ROWS = 1_000_000
MOST_RANGES = 65_536
SAMPLES_PER_RANGE = 16
#: High bits of the hash that narrow the search for a row's range.
CELL_BITS = 12
#: A range with more than so many times its share of bytes is subdivided.
OVERFULL = 2


def _key(prefix: str) -> list[str]:
    return [f"{prefix}_text", f"{prefix}_row"]


def _before(a: list[str], b: list[str]) -> Column:
    """Key ``a`` < key ``b``, in codegen-friendly form."""
    (a1, a2), (b1, b2) = map(F.col, a), map(F.col, b)
    return (a1 < b1) | ((a1 == b1) & (a2 < b2))


def splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Ranges by size-weighted sample: range, low_*, high_* (null: open end). At most ``ranges`` rows."""
    chance = F.col("size") * (ranges * SAMPLES_PER_RANGE / total)
    drawn = F.pmod(F.xxhash64(F.lit(7), "key_text", "key_row"), F.lit(1 << 52)) / float(1 << 52)
    sample = rows.where(drawn < chance).select("key_text", "key_row", F.greatest(F.lit(1.0), chance).alias("weight"))
    in_order = Window.orderBy("key_text", "key_row")  # the sample is bounded: about ranges * SAMPLES_PER_RANGE rows
    upto, whole = F.sum("weight").over(in_order), F.sum("weight").over(Window.partitionBy())
    step = sample.withColumn("step", F.floor(upto * ranges / whole))
    first = step.groupBy("step").agg(F.min(F.struct("key_text", "key_row")).alias("low"))
    low = first.where("step > 0").select(F.col("low.key_text").alias("low_text"), F.col("low.key_row").alias("low_row"))
    start = rows.sparkSession.range(1).select(F.lit(None).cast("long").alias("low_text"), F.lit(None).cast("long").alias("low_row"))
    low = start.unionByName(low.distinct())
    after = Window.orderBy(F.col("low_text").asc_nulls_first(), F.col("low_row").asc_nulls_first())
    return low.select(
        F.row_number().over(after).alias("range"),
        *_key("low"),
        F.lead("low_text").over(after).alias("high_text"),
        F.lead("low_row").over(after).alias("high_row"),
    )


def ranged(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` with their ``range``: an equi-join on the high bits of the hash, then the key's place between splitters."""
    cell = lambda c: F.shiftright(c, 64 - CELL_BITS)
    least, most = -(1 << (CELL_BITS - 1)), (1 << (CELL_BITS - 1)) - 1
    cells = F.sequence(F.coalesce(cell("low_text"), F.lit(least)), F.coalesce(cell("high_text"), F.lit(most)))
    wide = ranges.withColumn("cell", F.explode(cells))  # at most ranges + 2 ** CELL_BITS rows
    inside = (F.col("low_text").isNull() | ~_before(_key("key"), _key("low"))) & (
        F.col("high_text").isNull() | _before(_key("key"), _key("high"))
    )
    joined = rows.withColumn("row_cell", cell("key_text")).join(F.broadcast(wide), (F.col("row_cell") == F.col("cell")) & inside)
    return joined.drop("row_cell", "cell", *_key("low"), *_key("high"))


def shards(docs: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard from 0, and slot, gapless from 0 in each shard.

    The size is the UTF-8 bytes of the text and 1; a null text has none. Equal texts lie
    in one shard or in neighbouring ones. Null ids and repeated rows are rows like any
    other; an empty table has an empty result.
    """
    text = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key_text"),
        # Repeats of one row differ too: the rows are written with these keys, so a repeated task finds the same.
        F.xxhash64(F.col(id_col), F.octet_length(text), F.monotonically_increasing_id()).alias("key_row"),
    )
    rows = written(rows, "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(count * RANGES_PER_SHARD, min(MOST_RANGES, n // RANGE_ROWS))
    dealt = ranged(rows, written(splitters(rows, max(total, 1), ranges), "splitters"))

    part_bytes = F.greatest(F.lit(total / ranges), F.lit(1.0))
    parts = dealt.groupBy("range").agg(F.sum("size").alias("bytes"))
    parts = parts.select("range", F.when(F.col("bytes") > OVERFULL * part_bytes, F.ceil(F.col("bytes") / part_bytes)).otherwise(1).alias("parts"))
    dealt = dealt.join(F.broadcast(written(parts, "range-parts")), "range")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key_row", F.lit(11)), "parts")).drop("parts")

    sums = dealt.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    in_order = Window.orderBy("range", "part")  # bounded: at most twice as many rows as ranges
    middle = F.sum("bytes").over(in_order) - F.col("bytes") / 2
    plan = sums.withColumn("shard", F.least(F.floor(middle * count / max(total, 1)), F.lit(count - 1)).cast("int"))
    in_shard = Window.partitionBy("shard").orderBy("range", "part")
    plan = plan.select("range", "part", "shard", (F.sum("rows").over(in_shard) - F.col("rows")).alias("first_slot"))
    in_part = Window.partitionBy("range", "part").orderBy("key_text", "key_row", "doc_id")
    return dealt.join(F.broadcast(written(plan, "shard-plan")), ["range", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.row_number().over(in_part) - 1).alias("slot")
    )
