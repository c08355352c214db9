"""Token accounting."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_rows() -> Column:
    return F.count(F.lit(1))


def part(name: str) -> Column:
    return F.coalesce(F.col(f"usage.{name}"), F.lit(0))


def total() -> Column:
    """Every token shown to the model; reasoning is already inside output."""
    return part("input") + part("output") + part("cache_read") + part("cache_creation")


def sum_part(name: str) -> Column:
    return F.coalesce(F.sum(F.col(f"usage.{name}")), F.lit(0))


def sum_total() -> Column:
    return F.coalesce(F.sum(total()), F.lit(0))
