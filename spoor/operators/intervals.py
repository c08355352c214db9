"""Point-in-interval and nearest-point joins as equi-joins.

A range join on a hot key compares every point with every interval of that key.
Here the work stays linear:

* ``first_covering`` cuts each interval into aligned cells of 4^k milliseconds
  (at most six per level). The best candidate per cell is aggregated before the
  join, so each point meets one row per level however many intervals overlap.
* ``nearest_unique`` walks time inside hour slots, each seeing its own distinct
  instants plus one instant of either neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions import clock

RADIX = 4
LEVELS = 21          # 4^20 ms is 34 years
COARSE_LEVEL = 10    # cells from 17 minutes up are few, and hot: they are salted
COARSE_SALTS = 16


def _cells(lo: Column, hi: Column) -> Column:
    """array<struct(level, cell)> covering the inclusive range [lo, hi] exactly."""

    def span(a: Column, b: Column, level: Column) -> Column:
        return F.when(
            a < b,
            F.transform(F.sequence(a, b - 1), lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell"))),
        ).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))

    def at(step: Column) -> Column:
        level, size, up = step["level"], step["size"], step["up"]
        a, b = F.ceil(lo / size).cast("bigint"), F.floor((hi + 1) / size).cast("bigint")
        pa, pb = F.ceil(lo / up).cast("bigint"), F.floor((hi + 1) / up).cast("bigint")
        split = (pa < pb) & (level < LEVELS - 1)
        # Cells the next level covers are left to it.
        left = span(a, F.when(split, pa * RADIX).otherwise(b), level)
        right = span(F.when(split, pb * RADIX).otherwise(b), b, level)
        return F.concat(left, right)

    # Sizes are constants; a lambda would raise them to the level again wherever it reads them.
    steps = F.array(*[
        F.struct(F.lit(k).alias("level"), F.lit(RADIX ** k).cast("bigint").alias("size"), F.lit(RADIX ** (k + 1)).cast("bigint").alias("up"))
        for k in range(LEVELS)])
    return F.flatten(F.transform(steps, at))


def first_covering(points: DataFrame, intervals: DataFrame, key: str, at: str,
                   lo: str, hi: str, best: str) -> DataFrame:
    """Per distinct point, the smallest ``best`` among intervals of the same key
    with ``lo <= at <= hi``. Points without one do not appear.

    points: key, at (ms)     intervals: key, lo, hi (ms), best
    returns: key, at, best
    """
    coarse = F.col("level") >= COARSE_LEVEL
    # Intervals are few bytes and much work: by size alone they would meet in one task.
    tasks = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cover = (
        intervals.select(key, lo, hi, best).repartition(tasks, key, lo, hi)
        .select(key, best, F.explode(_cells(F.col(lo), F.col(hi))).alias("c"))
        .groupBy(key, F.col("c.level").alias("level"), F.col("c.cell").alias("cell"))
        .agg(F.min(best).alias(best))
        .withColumn("salt", F.explode(
            F.when(coarse, F.sequence(F.lit(0), F.lit(COARSE_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    )
    lookups = (
        points.select(key, at).distinct()
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
        .withColumn("cell", F.floor(F.col(at) / F.pow(F.lit(RADIX), F.col("level")).cast("bigint")).cast("bigint"))
        .withColumn("salt", F.when(coarse, F.pmod(F.hash(at), F.lit(COARSE_SALTS))).otherwise(0))
    )
    return (
        lookups.join(cover, [key, "level", "cell", "salt"])
        .groupBy(key, at).agg(F.min(best).alias(best))
    )


def nearest_unique(points: DataFrame, marks: DataFrame, key: str, at: str,
                   mark_at: str, owner: str, within_ms: int) -> DataFrame:
    """Per distinct point, the owner of the nearest mark of the same key within
    ``within_ms`` (at most one hour) on either side. When two owners share the
    nearest distance the point gets none.

    points: key, at (ms)     marks: key, mark_at (ms), owner
    returns: key, at, owner
    """
    if within_ms > clock.SLOT_MS:
        raise ValueError("within_ms must not exceed the slot length")
    targets = points.select(key, at).distinct().select(
        key, clock.slot(F.col(at)).alias("_slot"), F.col(at).alias("_at"))
    # Only slots that hold points, and their neighbours, matter.
    near = targets.select(key, F.explode(F.array(
        F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)).alias("_slot")).distinct()
    instants = (
        marks.select(key, F.col(mark_at).alias("_at"), owner)
        .withColumn("_slot", clock.slot(F.col("_at")))
        .join(near, [key, "_slot"], "left_semi")
        .groupBy(key, "_slot", "_at")
        .agg(F.min(owner).alias("_o1"), F.max(owner).alias("_o2"))
        .select(key, "_slot", F.struct("_at", "_o1", "_o2").alias("_mark"))
    )
    edges = instants.groupBy(key, "_slot").agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
    borrowed = edges.select(key, F.inline(F.array(
        F.struct((F.col("_slot") + 1).alias("_slot"), F.col("_last").alias("_mark")),
        F.struct((F.col("_slot") - 1).alias("_slot"), F.col("_first").alias("_mark")),
    )))
    line = (
        instants.unionByName(borrowed)
        .select(key, "_slot", F.col("_mark._at").alias("_at"), "_mark", F.lit(False).alias("_point"))
        .unionByName(targets.select(
            key, "_slot", "_at",
            F.lit(None).cast("struct<_at:bigint,_o1:string,_o2:string>").alias("_mark"),
            F.lit(True).alias("_point")))
    )
    # Frames by value, so a mark at the very instant counts on both sides. The
    # look-ahead is a running frame over descending time: a frame that reaches
    # forward would be re-evaluated for every row.
    slot = Window.partitionBy(key, "_slot")
    back = slot.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = slot.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        line.withColumn("_prev", F.last("_mark", ignorenulls=True).over(back))
        .withColumn("_next", F.last("_mark", ignorenulls=True).over(ahead))
        .where("_point")
    )
    far = F.lit(within_ms + 1)
    d1 = F.coalesce(F.col("_at") - F.col("_prev._at"), far)
    d2 = F.coalesce(F.col("_next._at") - F.col("_at"), far)
    low = F.when(d1 < d2, F.col("_prev._o1")).when(d2 < d1, F.col("_next._o1")) \
        .otherwise(F.least("_prev._o1", "_next._o1"))
    high = F.when(d1 < d2, F.col("_prev._o2")).when(d2 < d1, F.col("_next._o2")) \
        .otherwise(F.greatest("_prev._o2", "_next._o2"))
    return (
        found.where((F.least(d1, d2) <= within_ms) & (low == high))
        .select(key, F.col("_at").alias(at), low.alias(owner))
    )


def merged(ranges: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The union per key of inclusive ranges of whole numbers: keys, lo, hi, without overlap;
    ranges that touch become one."""
    by = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(lo) > reach + 1, F.lit(True)).cast("int")
    island = F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranges.where(F.col(lo) <= F.col(hi)).select(*keys, lo, hi).distinct().withColumn("_new", fresh).withColumn("_island", island)
        .groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")
    )


def gaps(ranges: DataFrame, keys: list[str], first: Column, last: Column, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """What ``merged`` ranges leave out of [first, last], per key that has a range: keys, lo, hi."""
    by = Window.partitionBy(*keys).orderBy(lo)
    rows = merged(ranges, keys, lo, hi).withColumn("_prev", F.lag(hi).over(by)).withColumn("_next", F.lead(lo).over(by))
    before = F.struct(F.greatest(F.coalesce(F.col("_prev") + 1, first), first).alias(lo), F.least(F.col(lo) - 1, last).alias(hi))
    after = F.struct(F.greatest(F.col(hi) + 1, first).alias(lo), last.alias(hi))
    found = F.array_compact(F.array(before, F.when(F.col("_next").isNull(), after)))
    return rows.select(*keys, F.inline(found)).where(F.col(lo) <= F.col(hi))
