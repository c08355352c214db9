"""Building blocks that stay even when one key holds a third of all rows.

Nothing here gathers a group into one task: ranks are cut down per salt before
the group meets, and medians are read off a histogram in two bounded steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int,
                    salt_on: list[str], rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows per key. A hot key is ranked per salt first, so the final
    ranking of a key sees at most ``n * SALTS`` rows."""
    salted = df.withColumn("_salt", F.pmod(F.hash(*salt_on), F.lit(SALTS)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
        .drop("_salt", "_r")
        .withColumn(rank_name, F.row_number().over(final)).where(F.col(rank_name) <= n)
    )


def group_median(hist: DataFrame, keys: list[str], value: str, count: str, cell: Column) -> DataFrame:
    """Exact median per key from a histogram ``keys, value, count``.

    ``cell`` is a monotone coarse value (one cell per range of values). Step one
    accumulates counts over cells and keeps the cells that hold the middle ranks;
    step two ranks the values of those cells only.

    Returns keys, ``median`` (mean of the two middle elements) and ``upper`` (the
    upper middle element).
    """
    hist = hist.where(F.col(value).isNotNull()).withColumn("_cell", cell)
    by_key = Window.partitionBy(*keys)
    cells = (
        hist.groupBy(*keys, "_cell").agg(F.sum(count).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(by_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(by_key))
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
        .where((F.col("_upto") >= F.col("_lo")) & (F.col("_upto") - F.col("_n") < F.col("_hi")))
        .select(*keys, "_cell", (F.col("_upto") - F.col("_n")).alias("_before"), "_lo", "_hi")
    )
    inner = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        hist.groupBy(*keys, "_cell", value).agg(F.sum(count).alias("_n"))
        .join(cells, keys + ["_cell"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inner))
    )
    lo = F.min(F.when(F.col("_upto") >= F.col("_lo"), F.col(value)))
    hi = F.min(F.when(F.col("_upto") >= F.col("_hi"), F.col(value)))
    return ranked.groupBy(*keys).agg(((lo + hi) / 2.0).alias("median"), hi.alias("upper"))


def rebalance(df: DataFrame, *cols: str) -> DataFrame:
    """Cluster rows by ``cols`` before a partitioned write; adaptive execution
    splits a hot value and merges small ones."""
    return df.hint("rebalance", *cols)
