"""Proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked; a row's place on the
line from 0 to 1 is its rank plus a fixed phase of the source, over the source's
rows.  Sorted by that place, every stretch of the line holds all sources in
proportion, so cutting it into equal pieces gives every shard the mixture.

No source is ranked in one task: ranks are counted per (source, hash bucket), the
buckets' starts come from their counts, and rows are numbered inside a bucket only.
The place on the line is numbered the same way.  The number of buckets bounds the
one table that meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.session import cut_lineage

#: hash buckets a source, and stretches of the line
BUCKETS = 2048


def interleave(
    docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, source, shard, slot.

    Shard sizes differ by one row at most; within a shard the rows of a source
    differ from its share by less than two.  ``slot`` counts from 0 without gaps in
    the order of the line.  Null sources are a source of their own; null texts have
    8 bytes of size and the checksum of the empty text.  Rows are ordered by hash,
    id, size and checksum, so repeated rows tie and are told apart only by slot.  The
    result does not depend on ``buckets`` or on how the input is partitioned.
    Equal texts are not held together: the counts come first.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    narrow = docs.select(
        F.col(id_col).alias("doc"), F.coalesce(F.col(source_col), F.lit("")).alias("s"),
        F.col(source_col).isNull().alias("s_null"), (F.octet_length(text) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
    )
    # null ids are told apart by their texts
    narrow = narrow.withColumn("h", F.xxhash64(F.lit(seed), "doc", F.when(F.col("doc").isNull(), F.col("text_crc32"))))
    # buckets are stretches of the hash's upper 31 bits, so the order over all of them is the hash's
    narrow = narrow.withColumn("top", F.shiftrightunsigned("h", 33))
    narrow = cut_lineage(narrow.withColumn("bucket", F.shiftright(F.col("top") * buckets, 31).cast("int")))
    per_bucket = narrow.groupBy("s", "s_null", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s", "s_null").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("s", "s_null")
    starts = per_bucket.select(
        "s", "s_null", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total"),
    )
    inside = Window.partitionBy("s", "s_null", "bucket").orderBy("top", "h", "doc", "size", "text_crc32")
    ranked = narrow.withColumn("i", F.row_number().over(inside)).join(starts, ["s", "s_null", "bucket"])
    phase = F.pmod(F.xxhash64(F.lit(seed + 1), "s", "s_null"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    placed = cut_lineage(ranked.select(
        "doc", "s", "s_null", "size", "text_crc32", "h",
        ((F.col("start") + F.col("i") - 1 + phase) / F.col("total")).alias("at"),
    ).withColumn("stretch", F.floor(F.col("at") * buckets).cast("int")))

    per_stretch = placed.groupBy("stretch").agg(F.count("*").alias("n"))
    line = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch: bounded
    starts = per_stretch.select(
        "stretch", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("stretch").orderBy("at", "s", "s_null", "h", "doc", "size", "text_crc32")
    numbered = placed.withColumn("i", F.row_number().over(inside)).join(starts, "stretch")
    at = F.col("start") + F.col("i") - 1
    return (
        numbered.withColumn("at", at)
        .withColumn("shard", F.expr(f"cast((at * {shards}) div total as int)"))
        .select(
            F.col("doc").alias(id_col), "size", "text_crc32", F.when(~F.col("s_null"), F.col("s")).alias(source_col), "shard",
            (F.col("at") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        )
    )
