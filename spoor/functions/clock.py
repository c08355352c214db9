"""Time buckets and millisecond arithmetic (session time zone is UTC)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_MS = 3_600_000


def bucket(ts: Column, granularity: str = "day", week_mode: str = "parity") -> Column:
    """Start date of the day, week or month holding ``ts``.

    Week buckets start on Monday. In 'parity' mode a timestamp that falls on a
    Monday belongs to the week before.
    """
    d = F.to_date(ts)
    if granularity == "month":
        return F.trunc(d, "month")
    if granularity == "week":
        if week_mode == "iso":
            return F.date_sub(F.next_day(d, "MON"), 7)
        return F.date_sub(F.next_day(F.date_sub(d, 1), "MON"), 7)
    return d


def ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def slot(millis: Column) -> Column:
    """Hour slot of a millisecond instant: the unit in which per-session and
    per-agent work is split, so that no task holds a whole hot session."""
    return F.floor(millis / SLOT_MS).cast("long")


def parse_ts(text: Column) -> Column:
    """ISO text to timestamp, NULL when it is not one."""
    return F.try_to_timestamp(F.when(F.trim(text) != "", text))
