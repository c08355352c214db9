"""Tables that a stream keeps: keyed rows in units that are replaced whole.

A unit is a combination of partition values (a day, say). A micro-batch reads the units its
rows fall in, merges, and writes them under its number; of each unit the latest whole
version counts, and the one before stays for readers and for a micro-batch that runs again,
which starts from what was there before it. Neither a read nor a micro-batch costs more for
the epochs gone by, and a micro-batch costs nothing for units it does not touch. A table
belongs to one checkpoint: epochs order its versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.operators import runs
from spoor.plans import lake


def _kept(spark: SparkSession, path: str, units: list[str]) -> dict[str, list[tuple[int, str]]]:
    """Per unit its whole versions, oldest first: epoch and folder."""
    whole = {p.rsplit("/", 2)[1] for p in lake.glob(spark, f"{path}/epoch=*/_SUCCESS")}
    out: dict[str, list[tuple[int, str]]] = {}
    for folder in lake.glob(spark, "/".join([path, "epoch=*", *[f"{u}=*" for u in units]])):
        epoch, *unit = folder.split("/")[-len(units) - 1:]
        if epoch in whole:
            out.setdefault("/".join(unit), []).append((int(epoch.removeprefix("epoch=")), folder))
    return {u: sorted(v) for u, v in out.items()}


def _of(spark: SparkSession, path: str, schema: T.StructType, units: list[str], folders: list[str]) -> DataFrame:
    """The rows of version folders. A folder's epoch is no column, its unit is."""
    if not folders:
        return spark.createDataFrame([], schema)
    by_epoch: dict[str, list[str]] = {}
    for f in folders:
        by_epoch.setdefault("/".join(f.split("/")[:-len(units)]), []).append(f)
    out = None
    for base, some in sorted(by_epoch.items()):
        rows = spark.read.schema(schema).option("basePath", base).parquet(*some)
        out = rows if out is None else out.union(rows)
    return out


def read(spark: SparkSession, path: str, schema: T.StructType, units: list[str]) -> DataFrame:
    """The latest version of every unit. ``schema`` includes the units' columns."""
    return _of(spark, path, schema, units, [v[-1][1] for v in _kept(spark, path, units).values()])


def upsert(rows: DataFrame, path: str, epoch: int, units: list[str], merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge ``rows`` into the table: ``merge`` gets the old and the new rows of the units
    touched as one frame and returns their new rows, in the same columns."""
    spark, schema = rows.sparkSession, rows.schema
    rows = runs.staged(rows, "upsert")
    touched = {lake.partition_path(**r.asDict()) for r in rows.select(*units).distinct().collect()}
    kept = _kept(spark, path, units)
    before = {u: [v for v in kept.get(u, []) if v[0] < epoch] for u in touched}
    old = _of(spark, path, schema, units, [v[-1][1] for v in before.values() if v])
    merged = merge(old.select(*schema.names).union(rows)).select(*schema.names)
    merged.repartition(*units).write.mode("overwrite").partitionBy(*units).parquet(f"{path}/epoch={epoch}")
    for versions in before.values():
        for _, folder in versions[:-1]:
            lake.delete(spark, folder)


def counted(old_and_new: DataFrame, keys: list[str]) -> DataFrame:
    """For ``upsert``: of each key the row of the latest epoch (column ``epoch``)."""
    values = F.struct(*[c for c in old_and_new.columns if c not in keys])
    return old_and_new.groupBy(*keys).agg(F.max_by(values, "epoch").alias("_v")).select(*keys, "_v.*")
