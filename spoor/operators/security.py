"""Findings: redaction markers left in trace text, and their reports."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import clock, secrets
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def extract_findings(traces: DataFrame) -> DataFrame:
    """One row per marker occurrence in any text field of a trace row."""
    fields = [c for c in V.FINDING_FIELDS if c in traces.columns]

    def hits_in(field: str) -> Column:
        return F.transform(secrets.markers(F.coalesce(field, F.lit(""))),
                           lambda m: F.struct(m.alias("pattern_type"), F.lit(field).alias("field")))

    if not traces.isStreaming:  # a cheap test first; on a stream all rows must reach the watermark
        traces = traces.where(reduce(or_, [F.col(c).contains("[REDACTED:") for c in fields]))
    date = [c for c in ("event_date",) if c in traces.columns]
    # One array of hits per row: rows without a marker produce nothing.
    hits = F.flatten(F.array(*[hits_in(c) for c in fields]))
    return (
        traces.select("ts", "agent", "session_id", "project", F.col("id").alias("source_id"), *date,
                      F.explode(hits).alias("hit"))
        .select("ts", "agent", "session_id", "project", F.col("hit.pattern_type").alias("pattern_type"),
                "source_id", F.col("hit.field").alias("field"), *date)
    )


def pattern_agents(findings: DataFrame) -> DataFrame:
    """Agents that left each pattern, over all time."""
    return findings.select("pattern_type", "agent").distinct()


def session_patterns(findings: DataFrame) -> DataFrame:
    """Patterns of each session, over all time."""
    return findings.where(F.col("session_id").isNotNull()).select("session_id", "pattern_type").distinct()


def findings_by_pattern(ws: Workspace, f: Filters = NO_FILTER, limit: int = 25) -> DataFrame:
    """Findings per pattern. In parity mode the agent list ignores the filters; with a date
    filter it is looked up for the patterns chosen from those dates."""
    keep = ws.finding_condition(f)
    if ws.parity and (f.days or f.date):
        chosen = findings_by_pattern(replace(ws, parity=False), f, limit)
        use = ws.pattern_agents if ws.pattern_agents is not None else pattern_agents(ws.findings)
        names = use.join(chosen.select("pattern_type"), "pattern_type", "left_semi").groupBy("pattern_type").agg(
            F.array_sort(F.collect_set("agent")).alias("agents"))
        return chosen.drop("agents").join(names, "pattern_type").select(*chosen.columns).orderBy(F.desc("count"), "pattern_type")
    small = (
        (ws.findings if ws.parity else ws.findings.where(keep))
        .groupBy("pattern_type", "session_id", "project", "agent")
        .agg(F.count_if(keep).alias("n"), F.min(F.when(keep, F.col("ts"))).alias("lo"),
             F.max(F.when(keep, F.col("ts"))).alias("hi"))
    )
    kept = F.col("n") > 0
    return (
        small.groupBy("pattern_type").agg(
            F.sum("n").alias("count"),
            F.countDistinct(F.when(kept, F.col("session_id"))).alias("sessions"),
            F.countDistinct(F.when(kept, F.col("project"))).alias("projects"),
            F.array_sort(F.collect_set("agent")).alias("agents"),
            F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))
        .where(F.col("count") > 0)
        .orderBy(F.desc("count"), "pattern_type").limit(limit)
    )


def findings_timeline(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    rows = (
        ws.findings.where(ws.finding_condition(f))
        .groupBy(clock.bucket(F.col("ts"), f.granularity, ws.week_mode).alias("date"), "pattern_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return rows.orderBy("date", "pattern_type") if ordered else rows


def findings_by_session(ws: Workspace, f: Filters = NO_FILTER, limit: int = 50) -> DataFrame:
    """Findings per session. In parity mode the pattern list ignores the filters; with a
    date filter it is looked up for the sessions chosen from those dates."""
    keep = ws.finding_condition(f)
    if ws.parity and (f.days or f.date):
        chosen = findings_by_session(replace(ws, parity=False), f, limit)
        use = ws.session_patterns if ws.session_patterns is not None else session_patterns(ws.findings)
        names = use.join(chosen.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(
            F.array_sort(F.collect_set("pattern_type")).alias("patterns"))
        return chosen.drop("patterns").join(names, "session_id").select(*chosen.columns).orderBy(F.desc("count"), "session_id")
    rows = ws.findings.where(F.col("session_id").isNotNull())
    if not ws.parity:
        rows = rows.where(keep)
    return (
        rows.groupBy("session_id").agg(
            F.min(F.when(keep, F.col("agent"))).alias("agent"), F.max(F.when(keep, F.col("project"))).alias("project"),
            F.count_if(keep).alias("count"), F.array_sort(F.collect_set("pattern_type")).alias("patterns"),
            F.min(F.when(keep, F.col("ts"))).alias("first_at"), F.max(F.when(keep, F.col("ts"))).alias("last_at"))
        .where(F.col("count") > 0)
        .orderBy(F.desc("count"), "session_id").limit(limit)
    )


def findings_pivot(ws: Workspace, patterns: list[str], f: Filters = NO_FILTER) -> DataFrame:
    """Date by pattern matrix; the pattern list is fixed up front, so no pass over
    the data is spent on finding the columns."""
    return (
        findings_timeline(ws, f, ordered=False).groupBy("date").pivot("pattern_type", patterns)
        .agg(F.sum("count")).orderBy("date")
    )


def secret_scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every secret in every text: id, type, start, end (overlaps between patterns
    included)."""
    return (
        df.where(secrets.has_secret(F.col(text_col)))
        .select(id_col, F.inline(secrets.find(F.col(text_col))))
    )
