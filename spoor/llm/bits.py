"""A filter of fixed size for keys, in built-in expressions: which rows can be in a set.

The set's keys set bits of maps of 4,096 bytes, one map per bucket; rows look their bit up.
All keys of the set pass, and of others few as long as there are fewer keys than bits;
beyond that more rows are moved, none is lost. ``buckets`` maps are all that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_BITS = 32768
#: Maps of a filter: 4 MB are broadcast at most, for 33 million bits.
BUCKETS = 1024


def free(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` column names, each with underscores before it until ``names`` lack it."""
    out = []
    for name in wanted:
        while name.lower() in {n.lower() for n in names} | {n.lower() for n in out}:
            name = "_" + name
        out.append(name)
    return out


def _place(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets * MAP_BITS))


def maps(keys: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The filter of the values of ``key``: one row (bucket, map) for each bucket that has one."""
    at = _place(F.col(key), buckets)
    return keys.groupBy(F.floor(at / MAP_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(at % MAP_BITS).alias("map"))


def passing(rows: DataFrame, key: str, filter_: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose ``key`` may be among the filter's; at most ``buckets`` maps are broadcast."""
    bucket, bits = free(rows.columns, "bucket", "map")
    at = _place(F.col(key), buckets)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at % MAP_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    small = F.broadcast(filter_.select(F.col("bucket").alias(bucket), F.col("map").alias(bits)))
    met = rows.withColumn(bucket, F.floor(at / MAP_BITS).cast("int")).join(small, bucket)
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop(bucket, bits)
