"""Sharding by jump consistent hashing, in built-in expressions only.

A row's shard depends on its key and the number of shards. The jump from shard b goes to
floor((b + 1) / r), where r in (0, 1] is drawn from the key and b; the last jump below
the number of shards decides. Appending a shard moves only the rows whose next jump lands
in it, about one in n + 1, and all of them into the new shard. No ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.llm import common

SHARDS = 16


def drawn(key: Column, bucket: int | Column) -> Column:
    """31 bits drawn from the key and the shard it jumps from."""
    seed = F.concat(key, F.lit(":"), F.lit(bucket).cast("string") if isinstance(bucket, int) else bucket.cast("string"))
    return F.shiftright(F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("bigint"), 1)


def jump(key: Column, shards: int) -> Column:
    """Shard of a text key (null counts as the empty text), 0 to ``shards`` - 1."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def step(at, _):
        b = at["next"]
        to = F.floor((b + 1).cast("double") * (F.lit(float(1 << 31)) / (drawn(key, b) + 1).cast("double"))).cast("bigint")
        return F.when(b < shards, F.struct(b.alias("shard"), to.alias("next"))).otherwise(at)

    zero = F.lit(0).cast("bigint")
    # b grows with each jump, so there are at most as many jumps as shards.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.struct(zero.alias("shard"), zero.alias("next")), step)["shard"].cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, shard, grown_shard (the shard
    if there were one more) and slot, which numbers the rows of a shard without gaps.

    Slots follow the key, then size and checksum, nulls first. The narrow rows are sorted
    over all tasks, repeated ones apart too, and written with their places; a row's slot is its
    shard's rows in the parts before plus its place behind the first of its own part. No
    task sees a shard whole, however large. Null text: size 1, the checksum of nothing.
    Null keys share a shard. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    narrow = common.stage(docs.select(
        F.col(key), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        jump(F.col(key), shards).alias("shard"), jump(F.col(key), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("row")), "shards")
    placed = common.stage(narrow.orderBy("shard", key, "size", "text_crc32", "row").withColumns({
        "part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "places")
    parts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return (placed.join(parts, ["shard", "part"])
            .select(key, "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).cast("bigint").alias("slot"), "grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
