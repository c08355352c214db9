"""Numbered rows and bounded runs of them, however long a key's list is.

``numbered`` gives rows their place in their key's order without a window over the key: rows
are sorted over all tasks, and a place is the key's rows in the parts before plus the place
in its own part.

``cut`` deals each key's rows, in order, to runs that hold at most so many rows and so many
bytes; a row that is larger alone makes a run of its own. Where a run ends depends on where
it began, so the cuts follow one another. They are found without walking them:

* rows meet in blocks of fixed length, with the sizes of the next block's first rows. There
  each row knows where a run that began with it would end, by a search in prefix sums, and
  pointer doubling tells at which row of the next block a chain of runs through this block
  comes out. Since a run is bounded, only the first ``max_rows`` rows of a block can be
  entered.
* the chains of the blocks are composed by pointer doubling over blocks: after k rounds
  2^k blocks of a key know where they are entered.
* each block then cuts itself from its entry on.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor import session

#: Rows of a block: what a task holds at once of a key, eight bytes each.
BLOCK = 1 << 16

#: Whether shuffle files go when the query that wrote them has ended.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_noting: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``staged`` writes inside goes at the end, and each step's shuffle files go with the
    step: a job of many steps then holds no more than the largest needs. All that reads them
    must have ended inside."""
    from spoor.plans import lake

    made: list[str] = []
    before = spark.conf.get(DROPPED, None)
    _noting.append(made)
    spark.conf.set(DROPPED, "true")
    try:
        yield
    finally:
        _noting.remove(made)
        spark.conf.set(DROPPED, before) if before is not None else spark.conf.unset(DROPPED)
        for folder in made:
            lake.delete(spark, folder)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the work folder and read again: their lineage ends there."""
    folder = session.work_folder(rows.sparkSession, name)
    for made in _noting[-1:]:
        made.append(folder)
    path = folder + "/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos") -> DataFrame:
    """``rows`` with their place, from 0, among those of equal ``keys`` by ``order``. Equal
    rows come in any order. Null keys are a key."""
    own = [f"_key{i}" for i in range(len(keys))]
    placed = staged(rows.orderBy(*keys, *order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "numbered")
    parts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = parts.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("_part").alias("_p"),
                         (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k, o in zip(keys, own):
        same &= F.col(k).eqNullSafe(F.col(o))
    return placed.join(shift, same).withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_p", "_shift", *own)


def _jumps(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For each row the first row that a run beginning with it does not take."""
    total = np.append(0, np.cumsum(sizes))
    at = np.arange(len(sizes))
    fits = np.searchsorted(total, total[:-1] + max_bytes, "right") - 1
    return np.minimum(np.maximum(fits, at + 1), at + max_rows)


def _exits(jump: np.ndarray, length: int) -> np.ndarray:
    """Where the chain of runs from each row of a block first leaves its ``length`` rows."""
    out = jump[:length].copy()
    while True:
        inside = out < length
        if not inside.any():
            return out
        out[inside] = out[out[inside]]


def _chain(jump: np.ndarray, entry: int, length: int) -> list[int]:
    out = []
    while entry < length:
        out.append(entry)
        entry = int(jump[entry])
    return out


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at, at[1:])]


def cut(sizes: DataFrame, max_rows: int, max_bytes: int, block: int = BLOCK) -> DataFrame:
    """(key, pos, start): for each row the place of the first row of its run.

    sizes: key, pos (from 0, without gaps), size (bytes). ``block`` must not be less than
    ``max_rows``; it does not change the result.
    """
    if max_rows > block:
        raise ValueError("a block must hold a whole run")
    rows = sizes.select("key", F.floor(F.col("pos") / block).alias("block"), "pos", "size")
    held = staged(rows.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "size")))["size"].alias("sizes")), "blocks")
    heads = held.select(F.col("key").alias("_key"), (F.col("block") - 1).alias("_block"), F.slice("sizes", 1, max_rows).alias("ahead"))
    near = (F.col("key").eqNullSafe(F.col("_key"))) & (F.col("block") == F.col("_block"))
    held = staged(held.join(heads, near, "left").select("key", "block", "sizes", "ahead"), "blocks")

    def through(batches):
        for batch in batches:
            block_, entry, leave, owner = batch.column("block").to_numpy(), [], [], []
            for i, (own, ahead) in enumerate(zip(_lists(batch, "sizes"), _lists(batch, "ahead"))):
                out = _exits(_jumps(np.concatenate([own, ahead]), max_rows, max_bytes), len(own))
                n = min(len(own), max_rows if block_[i] else 1)  # the first block is entered at its first row
                entry.append(np.arange(n))
                leave.append(out[:n] - len(own))
                owner.append(np.full(n, i))
            at = pa.array(np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("block").take(at), *(pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (entry, leave))],
                names=["key", "block", "entry", "leave"])

    kind = held.schema["key"].dataType.simpleString()
    last = held.groupBy("key").agg(F.max("block").alias("last")).where("last > 0")
    most = last.agg(F.max("last")).first()[0] or 0
    entries = held.where("block = 0").select("key", "block", F.lit(0).cast("bigint").alias("entry"))
    if most:
        steps = staged(held.join(last.select("key"), "key", "left_semi").mapInArrow(through, f"key {kind}, block long, entry long, leave long"), "steps")
        length = 1
        while True:
            on = entries.join(steps, ["key", "block", "entry"]).select("key", (F.col("block") + length).alias("block"), F.col("leave").alias("entry"))
            entries = staged(entries.union(on), "entries")
            if 2 * length > most:
                break
            after = steps.select("key", (F.col("block") - length).alias("block"), F.col("entry").alias("leave"), F.col("leave").alias("_far"))
            steps = staged(steps.join(after, ["key", "block", "leave"]).select("key", "block", "entry", F.col("_far").alias("leave")), "steps")
            length *= 2

    def dealt(batches):
        for batch in batches:
            for i, (own, ahead) in enumerate(zip(_lists(batch, "sizes"), _lists(batch, "ahead"))):
                jump = _jumps(np.concatenate([own, ahead]), max_rows, max_bytes)
                base, n = batch.column("block")[i].as_py() * block, len(own)
                starts = np.array(_chain(jump, batch.column("entry")[i].as_py(), n), np.int64)
                at = np.searchsorted(starts, np.arange(n), "right") - 1
                known = at >= 0  # rows before the entry belong to the block before
                start = np.where(known, starts[np.maximum(at, 0)] if n and len(starts) else 0, 0) + base
                for a in range(0, n, 10_000):
                    some = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(np.full(len(start[some]), i))), pa.array(np.arange(n)[some] + base), pa.array(start[some], mask=~known[some])], names=["key", "pos", "start"])

    entered = held.join(entries, ["key", "block"])
    out = entered.mapInArrow(dealt, f"key {kind}, pos long, start long")
    if not most:
        return out
    # The rows a run takes from the next block: between its end there and the run's start.
    out = staged(out, "runs")
    tails = out.where("start IS NOT NULL").groupBy("key", F.floor(F.col("pos") / block).alias("block")).agg(F.max("start").alias("carried"))
    open_ = out.where("start IS NULL").withColumn("block", F.floor(F.col("pos") / block) - 1).join(tails, ["key", "block"])
    return out.where("start IS NOT NULL").union(open_.select("key", "pos", F.col("carried").alias("start")))
