"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are put in one total order; each range of it is summed by itself, the ranges' totals are prefix-summed, and a row
goes to the shard in which the middle of its bytes falls. Shards are contiguous in the order and differ from the equal
target by at most one row's size. DataFrame functions only.

Defined cases: a null text has no bytes (its size is the overhead alone); an empty table gives no rows; rows with a
null key come first; equal rows are interchangeable; a row larger than the target leaves shards that it covers empty;
columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import checkpointed, global_prefix

OVERHEAD = 16


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row for each of df's: key, size, text_crc32, law ('bytes'), shard, slot (gapless from 0), grown_shard (null)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = df.select(F.col(key).alias("row_key"), (F.octet_length(body).cast("long") + overhead).alias("size"), F.crc32(body).alias("text_crc32"))
    ranked, totals = global_prefix(digest, [], ["row_key", "text_crc32", "size"], "size")
    total = totals.agg(F.sum("amount")).first()[0] or 1
    middle = F.expr(f"((2 * before + size) * {shards}) div (2 * {total})")
    placed = checkpointed(ranked.withColumn("shard", middle.cast("int")))
    heads = placed.groupBy("shard").agg(F.min("rank").alias("head"))
    return placed.join(heads, "shard").select(
        F.col("row_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
