"""What is derived from the traces of a lake, kept up to date by the partitions that changed.

Every derived table has the partitions of the traces, (event_date, agent), and holds for
each of them only what its rows give. A refresh recomputes the partitions that are touched,
and of these alone the traces are read. Totals over all time are small; they are merged by
the difference between a partition's old and new rows and kept as numbered versions, so a
refresh that runs again adds nothing. Commits are linked anew where a session's window or an
agent's activity moved: hour cells of the change pick them.

    findings          markers left in the text
    pattern_days      markers per pattern
    session_patterns  patterns per session
    tool_days         rows per tool
    session_days      first and last instant per project and session
    session_sketches  the sessions of each project as a sketch, for counts over long ranges
    totals            rows per tool and agent, and markers per pattern and agent, over all time
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import fixed_values as V
from spoor import schema as S
from spoor import session
from spoor.functions import clock
from spoor.operators import attribution, security
from spoor.operators.skew import rebalance
from spoor.plans import lake

PART = ["event_date", "agent"]
_PART = [T.StructField("event_date", T.DateType()), T.StructField("agent", T.StringType())]


def _schema(**fields) -> T.StructType:
    return T.StructType([*[T.StructField(k, t) for k, t in fields.items()], *_PART])


_TEXT, _LONG = T.StringType(), T.LongType()
SCHEMAS = {
    "findings": T.StructType([*S.FINDINGS.fields, _PART[0]]),
    "pattern_days": _schema(pattern_type=_TEXT, n=_LONG),
    "session_patterns": _schema(session_id=_TEXT, pattern_type=_TEXT),
    "tool_days": _schema(tool_name=_TEXT, n=_LONG),
    "session_days": _schema(project=_TEXT, session_id=_TEXT, lo=_LONG, hi=_LONG),
    "session_sketches": _schema(project=_TEXT, sessions=T.BinaryType()),
}
#: Log of the sketches' size: 4,096 registers.
SKETCH_LG = 12
TOTALS = T.StructType([T.StructField("kind", _TEXT), T.StructField("name", _TEXT), T.StructField("agent", _TEXT), T.StructField("n", _LONG)])
Touched = list[tuple[dt.date | None, str | None]]


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")


def _made(traces: DataFrame, folder: str) -> dict[str, DataFrame]:
    """The derived tables of ``traces``, staged in ``folder``."""
    spark, at = traces.sparkSession, clock.ms(F.col("ts"))
    n = F.count(F.lit(1)).alias("n")

    def staged(name: str, rows: DataFrame) -> DataFrame:
        rows.select(*[f.name for f in SCHEMAS[name].fields]).write.parquet(f"{folder}/{name}")
        return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")

    found = staged("findings", security.extract_findings(traces))
    return {
        "findings": found,
        "pattern_days": staged("pattern_days", found.groupBy(*PART, "pattern_type").agg(n)),
        "session_patterns": staged("session_patterns", found.where(F.col("session_id").isNotNull()).select(*PART, "session_id", "pattern_type").distinct()),
        "tool_days": staged("tool_days", traces.where(F.col("tool_name").isNotNull()).groupBy(*PART, "tool_name").agg(n)),
        "session_days": staged("session_days", traces.where(
            F.col("session_id").isNotNull() & F.col("project").isNotNull() & F.col("ts").isNotNull()
        ).groupBy(*PART, "project", "session_id").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))),
        "session_sketches": staged("session_sketches", traces.where(F.col("session_id").isNotNull()).groupBy(*PART, "project").agg(
            F.hll_sketch_agg("session_id", F.lit(SKETCH_LG)).alias("sessions"))),
    }


def in_parts(touched: Touched) -> Column:
    """Rows of the partitions ``touched``."""
    return lake.in_units(PART, touched)


def _write(rows: DataFrame, path: str, whole: bool) -> None:
    rebalance(rows, *PART).write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy(*PART).parquet(path)


def _replace(rows: DataFrame, path: str, touched: Touched) -> None:
    """Put ``rows`` in place of the partitions ``touched``; those without rows go."""
    _write(rows, path, whole=False)
    have = {(r.event_date, r.agent) for r in rows.select(*PART).distinct().collect()}
    for date, agent in touched:
        if (date, agent) not in have:
            lake.delete(rows.sparkSession, f"{path}/{lake.partition_path(event_date=date, agent=agent)}")


# ---- totals -----------------------------------------------------------------------

def _totals_of(tables: dict[str, DataFrame]) -> DataFrame:
    tools, patterns = tables["tool_days"], tables["pattern_days"]
    both = tools.select(F.lit("tool").alias("kind"), F.col("tool_name").alias("name"), "agent", "n").union(
        patterns.select(F.lit("pattern"), "pattern_type", "agent", "n"))
    return both.groupBy("kind", "name", "agent").agg(F.sum("n").alias("n"))


def totals(spark: SparkSession, out: str) -> DataFrame:
    """kind ('tool' or 'pattern'), name, agent, n over all time."""
    return spark.read.schema(TOTALS).parquet(lake.versions(spark, f"{out}/totals")[-1])


def _merge_totals(spark: SparkSession, out: str, old: dict[str, DataFrame], new: dict[str, DataFrame], tag: str) -> None:
    """Add what the touched partitions gained and lost to the latest version, as a new one,
    unless the latest is this refresh's own."""
    done = lake.versions(spark, f"{out}/totals")
    if done and done[-1].endswith(f"-{tag}"):
        return
    change = _totals_of(new).union(_totals_of(old).withColumn("n", -F.col("n")))
    if done:
        change = totals(spark, out).union(change)
    rows = change.groupBy("kind", "name", "agent").agg(F.sum("n").alias("n")).where("n <> 0")
    lake.write_version(rows, f"{out}/totals", tag)


# ---- build and refresh ---------------------------------------------------------------

def build(spark: SparkSession, out: str) -> None:
    """All derived tables from all traces of ``out``."""
    made = _made(lake.read_traces(spark, f"{out}/traces"), session.work_folder(spark, "derived"))
    for name, rows in made.items():
        _write(rows, f"{out}/{name}", whole=True)
    for path in lake.versions(spark, f"{out}/totals"):
        lake.delete(spark, path)
    _merge_totals(spark, out, {n: rows.limit(0) for n, rows in made.items()}, made, uuid.uuid4().hex)


def touched_by(rows: DataFrame) -> Touched:
    """The partitions that ``rows`` (a micro-batch, say) lie in."""
    return [(r.event_date, r.agent) for r in rows.select(*PART).distinct().collect()]


def refresh(spark: SparkSession, out: str, touched: Touched, tag: str | None = None) -> None:
    """Bring the derived tables and the links of commits up to the traces, given the
    partitions of these that changed since. ``tag`` names the refresh: one that broke off
    can run again under it. The order makes that safe: links and totals compare a
    partition's new rows with its old ones, which are replaced last."""
    if not touched:
        return
    if not lake.exists(spark, f"{out}/session_days"):
        return build(spark, out)
    new = _made(lake.read_traces(spark, f"{out}/traces").where(in_parts(touched)), session.work_folder(spark, "refresh"))
    old = {name: read(spark, out, name).where(in_parts(touched)) for name in new}
    if lake.exists(spark, f"{out}/git_events"):
        relink(spark, out, old["session_days"], new["session_days"], touched)
    _merge_totals(spark, out, old, new, tag or uuid.uuid4().hex)
    for name in SCHEMAS:
        _replace(new[name], f"{out}/{name}", touched)


def sessions_estimate(spark: SparkSession, out: str, since: dt.date | None = None, until: dt.date | None = None) -> DataFrame:
    """project, sessions: distinct sessions per project from the stored sketches, no traces
    read. The standard error is 1.04 / sqrt(2^SKETCH_LG), 1.6 %."""
    rows = read(spark, out, "session_sketches")
    if since:
        rows = rows.where(F.col("event_date") >= F.lit(since))
    if until:
        rows = rows.where(F.col("event_date") <= F.lit(until))
    return rows.groupBy("project").agg(F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"))


# ---- links ------------------------------------------------------------------------------

def windows(days: DataFrame, padding_ms: int = V.SESSION_PADDING_MS) -> DataFrame:
    """Padded activity window per (project, session), as ``attribution.session_windows``
    makes them from traces."""
    return days.groupBy("project", "session_id").agg(
        F.min("agent").alias("agent"), (F.min("lo") - padding_ms).alias("start_ms"), (F.max("hi") + padding_ms).alias("end_ms"))


def _moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, _slot): the hour cells in which a window appeared, went or changed hands."""
    ends = ("agent", "start_ms", "end_ms")
    b = before.select("project", "session_id", F.struct(*ends).alias("b"))
    a = after.select("project", "session_id", F.struct(*ends).alias("a"))
    both = b.join(a, ["project", "session_id"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    lo, hi = ([F.col(f"{t}.{c}") for t in "ab"] for c in ("start_ms", "end_ms"))
    whole = F.array(F.struct(F.least(*lo).alias("x"), F.greatest(*hi).alias("y")))
    ranges = F.array(*[F.struct(F.least(*c).alias("x"), F.greatest(*c).alias("y")) for c in (lo, hi)])
    grew = F.col("a.agent").eqNullSafe(F.col("b.agent")) & F.col("a").isNotNull() & F.col("b").isNotNull()
    moved = both.select("project", F.explode(F.when(grew, F.filter(ranges, lambda r: r["x"] < r["y"])).otherwise(whole)).alias("r"))
    return moved.select("project", F.explode(F.sequence(clock.slot(F.col("r.x")), clock.slot(F.col("r.y")))).alias("_slot")).distinct()


def _dates(cells: DataFrame) -> list[dt.date]:
    """The days of hour cells and their neighbours: authors' calendars differ by a day."""
    day = F.to_date(F.timestamp_millis(F.col("_slot") * clock.SLOT_MS))
    near = cells.select(F.explode(F.array(F.date_sub(day, 1), day, F.date_add(day, 1))).alias("d")).distinct()
    return [r.d for r in near.collect()]


def relink(spark: SparkSession, out: str, old_days: DataFrame, new_days: DataFrame, touched: Touched) -> None:
    """Link anew the commits that a change of the traces can reach, as if all were linked
    again: those in the hours in which a window of their project moved, and those of the
    touched agents on the touched dates. Links that a source gave stay.

    Commits, and the traces near them, are read by these dates only; windows come from
    ``session_days``. Partitions of commits are rewritten where a link changed.
    """
    days = read(spark, out, "session_days")
    keys = old_days.unionByName(new_days).select("project", "session_id").distinct()
    # The state after the refresh: the touched partitions' rows replaced.
    state = days.where(~in_parts(touched)).unionByName(new_days)
    cells = _staged(_moved(*[windows(d.join(keys, ["project", "session_id"], "left_semi")) for d in (days, state)]), "cells")
    # A row's own date may be a local one: a day of slack, and the hour that activity reaches.
    hours = [(agent, int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp()) // 3600) for d, agent in touched if d and agent]
    agents = spark.createDataFrame(hours, "agent string, _first long").select(
        "agent", F.explode(F.sequence(F.col("_first") - 25, F.col("_first") + 49)).alias("_slot")).distinct()
    dates = _dates(cells.select("_slot").union(agents.select("_slot")))
    if not dates:
        return
    git = lake.read_git(spark, f"{out}/git_events", linked=True).where(F.col("event_date").isin(dates))
    can = git.where(F.col("agent_authored") & F.col("ts").isNotNull() & (F.col("session_id").isNull() | F.col("linked_by").isNotNull()))
    can = can.withColumn("_slot", clock.slot(clock.ms(F.col("ts"))))
    near = can.join(cells, ["project", "_slot"], "left_semi").select(*git.columns).union(
        can.join(agents.withColumnRenamed("agent", "agent_name"), ["agent_name", "_slot"], "left_semi").select(*git.columns))
    filled = F.col("linked_by") == attribution.FILLED
    raw = _staged(near.withColumns({
        "_session": F.col("session_id"), "_agent": F.col("agent_name"), "_by": F.col("linked_by"),
        "session_id": F.lit(None).cast("string"), "agent_name": F.when(filled, F.lit(None)).otherwise(F.col("agent_name")),
    }).dropDuplicates(["repo", "commit_sha"]), "orphans")
    reach = _dates(raw.select(clock.slot(clock.ms(F.col("ts"))).alias("_slot")).distinct())
    if not reach:
        return
    traces = lake.read_traces(spark, f"{out}/traces").where(F.col("event_date").isin(reach))
    own = windows(state.join(raw.select("project").distinct(), "project", "left_semi"))
    again = attribution.link_commits(raw, traces, own, "linked_by")
    same = functools.reduce(operator.and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in (("session_id", "_session"), ("agent_name", "_agent"), ("linked_by", "_by"))])
    change = _staged(again.where(~same).select(
        F.coalesce("repo", F.lit("")).alias("_repo"), F.col("commit_sha").alias("_sha"), "event_date", "repo_hash",
        F.struct("session_id", "agent_name", "linked_by").alias("_new")), "links")
    parts = [(r.event_date, r.repo_hash) for r in change.select("event_date", "repo_hash").distinct().collect()]
    if not parts:
        return
    rows = git.where(lake.in_units(["event_date", "repo_hash"], parts)).join(change.drop("event_date", "repo_hash"), (F.coalesce("repo", F.lit("")) == F.col("_repo")) & (F.col("commit_sha") == F.col("_sha")), "left")
    fresh = rows.select(*[(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in ("session_id", "agent_name", "linked_by") else F.col(c))
                          for c in git.columns if c not in ("event_date", "repo_hash")])
    lake.write_git(_staged(fresh, "commits"), f"{out}/git_events", mode="overwrite")


def _staged(rows: DataFrame, name: str) -> DataFrame:
    path = session.work_folder(rows.sparkSession, f"relink/{name}") + "/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
