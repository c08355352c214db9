"""Per-session facts: one aggregation pass feeds every session-level query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import calls, clock, tokens
from spoor.operators.skew import top_n_per_group
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def session_facts(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """One row per session with every count and bound the detectors use.

    All detectors filter the same rows, so their sub-queries are conditional
    aggregates of one pass; unused ones are pruned by the optimizer.
    """
    edit, check, read = calls.is_edit(), calls.is_validation(), calls.is_read()
    return (
        ws.trace_rows(f, F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.min("agent").alias("agent"),
            F.max("project").alias("project"),
            F.min("project").alias("first_project"),
            F.min("ts").alias("started"),
            F.max("ts").alias("ended"),
            F.count(F.lit(1)).alias("entries"),
            tokens.sum_total().alias("tokens"),
            tokens.sum_part("input").alias("input_tokens"),
            tokens.sum_part("output").alias("output_tokens"),
            tokens.sum_part("cache_read").alias("cache_read"),
            tokens.sum_part("cache_creation").alias("cache_creation"),
            F.max(F.when(edit, F.col("ts"))).alias("last_edit_at"),
            F.max(F.when(check, F.col("ts"))).alias("last_validation_at"),
            F.min(F.when(edit | check, F.col("ts"))).alias("first_call_at"),
            F.count_if(calls.is_user_message()).alias("user_turns"),
            F.count_if(calls.is_tool_call()).alias("tool_calls"),
            F.count_if(read).alias("reads"),
            F.count_if(edit).alias("edits"),
        )
    )


def agent_commits(ws: Workspace) -> DataFrame:
    """Commits and changed lines per session, agent-authored only. Trace filters
    do not reach git history."""
    loc = F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    return (
        ws.git.where((F.col("event_type") == "commit") & F.col("session_id").isNotNull() & F.col("agent_authored"))
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.coalesce(F.sum(loc), F.lit(0)).alias("loc_delta"),
            F.min("ts").alias("first_commit_at"),
        )
    )


def session_metrics(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Session facts with commit totals; both sides have one row per session."""
    zero = F.lit(0).cast("bigint")
    return (
        session_facts(ws, f).join(agent_commits(ws), "session_id", "left")
        .withColumn("commits", F.coalesce("commits", zero))
        .withColumn("loc_delta", F.coalesce("loc_delta", zero))
    )


def _instants(rows: DataFrame) -> DataFrame:
    """Distinct (session, hour slot, millisecond) with entry counts. An hour slot
    has a bounded number of instants however many rows a session has."""
    at = clock.ms(F.col("ts"))
    return (
        rows.select("session_id", clock.slot(at).alias("slot"), at.alias("at"))
        .groupBy("session_id", "slot", "at").agg(F.count(F.lit(1)).alias("n"))
    )


def _slots(instants: DataFrame) -> DataFrame:
    """Per (session, slot): bounds, entries, active time inside the slot, and the
    last instant of the slot before it."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("session_id", "slot").orderBy("at"))
    return (
        instants.withColumn("gap", gap)
        .groupBy("session_id", "slot")
        .agg(
            F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("gap") <= V.IDLE_GAP_MS, F.col("gap"))), F.lit(0)).alias("inside"),
        )
        .withColumn("before", F.col("first_at") - F.lag("last_at").over(
            Window.partitionBy("session_id").orderBy("slot")))
    )


def active_time(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """session_id, active_ms: the sum of gaps of at most five minutes between
    consecutive entries. Gaps are taken inside hour slots, then across them."""
    rows = ws.trace_rows(f, F.col("session_id").isNotNull())
    crossing = F.coalesce(F.when(F.col("before") <= V.IDLE_GAP_MS, F.col("before")), F.lit(0))
    return _slots(_instants(rows)).groupBy("session_id").agg(
        F.sum(F.col("inside") + crossing).alias("active_ms"))


def session_activity(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Sparkline: 60 equal buckets of wall time per session (session_id, bucket,
    bucket_ms, entries), zero-filled. A single-instant session has one bucket."""
    instants = _instants(ws.trace_rows(f, F.col("session_id").isNotNull()))
    by_slot = instants.groupBy("session_id", "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    whole = Window.partitionBy("session_id")
    n = V.SPARKLINE_BUCKETS
    # Session bounds travel on (session, slot), so rows of a hot session meet them
    # in as many tasks as it has hours.
    bounds = (
        by_slot.select("session_id", "slot", F.min("lo").over(whole).alias("first_at"),
                       F.max("hi").over(whole).alias("last_at"))
        .withColumn("width", F.greatest(F.lit(1), F.floor((F.col("last_at") - F.col("first_at")) / n)).cast("bigint"))
    )
    index = F.when(F.col("last_at") <= F.col("first_at"), 0).otherwise(
        F.least(F.lit(n - 1), F.floor((F.col("at") - F.col("first_at")) / F.col("width"))))
    counted = (
        instants.join(bounds, ["session_id", "slot"])
        .groupBy("session_id", index.cast("int").alias("bucket")).agg(F.sum("n").alias("entries"))
    )
    frame = (
        by_slot.groupBy("session_id").agg(F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))
        .withColumn("width", F.greatest(F.lit(1), F.floor((F.col("last_at") - F.col("first_at")) / n)).cast("bigint"))
        .withColumn("bucket", F.explode(F.when(F.col("last_at") <= F.col("first_at"), F.array(F.lit(0)))
                                        .otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    )
    return (
        frame.join(counted, ["session_id", "bucket"], "left")
        .select("session_id", "bucket", (F.col("first_at") + F.col("bucket") * F.col("width")).alias("bucket_ms"),
                F.coalesce("entries", F.lit(0)).alias("entries"))
    )


def idle_segments(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Stretches of activity: a gap of more than five minutes starts a new one.

    Segment ends are found on slot pieces: a row starts a segment when the entry
    before it, inside its slot or at the end of the slot before, is too far.
    """
    instants = _instants(ws.trace_rows(f, F.col("session_id").isNotNull()))
    per_slot = _slots(instants).select("session_id", "slot", "before")
    inside = F.col("at") - F.lag("at").over(Window.partitionBy("session_id", "slot").orderBy("at"))
    far = F.coalesce("gap", "before") > V.IDLE_GAP_MS
    local = (
        instants.withColumn("gap", inside).join(per_slot, ["session_id", "slot"])
        .withColumn("starts", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("part", F.sum("starts").over(
            Window.partitionBy("session_id", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("session_id", "slot", "part")
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("n").alias("n"), F.max("starts").alias("opens"))
    )
    # Pieces of one session: at most thirteen per hour slot.
    number = F.sum("opens").over(Window.partitionBy("session_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0))
    return (
        local.withColumn("segment", number).groupBy("session_id", "segment")
        .agg(F.min("lo").alias("started_ms"), F.max("hi").alias("ended_ms"), F.sum("n").alias("entries"))
    )


def rollups(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Per session: tokens, active time, commits, changed lines, tokens per line."""
    return (
        session_metrics(ws, f).join(active_time(ws, f), "session_id")
        .select(
            "session_id", "agent", "project", "started", "ended", "active_ms", "tokens", "commits", "loc_delta",
            (F.col("tokens") / F.greatest(F.col("loc_delta"), F.lit(1))).alias("tokens_per_loc"),
        )
    )


def dark_spend(ws: Workspace, f: Filters = NO_FILTER, limit: int = 50) -> DataFrame:
    """Sessions that shipped code, costliest per line first."""
    return (
        rollups(ws, f).where(F.col("loc_delta") > 0)
        .orderBy(F.desc("tokens_per_loc"), "session_id").limit(limit)
    )


def zero_code(ws: Workspace, f: Filters = NO_FILTER, limit: int = 50) -> DataFrame:
    """Sessions that shipped no line, most tokens first."""
    return (
        rollups(ws, f).where(F.col("loc_delta") == 0)
        .orderBy(F.desc("tokens"), "session_id").limit(limit)
    )


def sessions(ws: Workspace, f: Filters = NO_FILTER, limit: int = 50) -> DataFrame:
    """Session list, newest first. Tool and model pick sessions that contain such
    a row anywhere (the MCP sentinel is a plain name here); agent does not apply."""
    rows = ws.trace_rows(Filters(days=f.days, project=f.project), F.col("session_id").isNotNull())
    for column, value in (("tool_name", f.tool), ("model", f.model)):
        if value:
            holders = ws.traces.where(F.col(column) == value).select("session_id").distinct()
            rows = rows.join(holders, "session_id", "left_semi")
    return (
        rows.groupBy("session_id").agg(
            F.min("agent").alias("agent"), F.min("project").alias("project"),
            F.min("ts").alias("started"), F.max("ts").alias("ended"),
            F.count(F.lit(1)).alias("entries"), tokens.sum_part("output").alias("output_tokens"))
        .orderBy(F.desc("started"), "session_id").limit(limit)
    )


def _keyed(ws: Workspace, session_id: str | None) -> DataFrame:
    df = ws.traces.where(F.col("session_id").isNotNull())
    return df.where(F.col("session_id") == session_id) if session_id else df


def session_summary(ws: Workspace, session_id: str | None = None) -> DataFrame:
    """Totals of every session, or of one. Its tools and models are the child
    tables ``session_tools`` and ``session_models``."""
    return _keyed(ws, session_id).groupBy("session_id").agg(
        F.min("agent").alias("agent"), F.min("project").alias("project"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.count(F.lit(1)).alias("entries"),
        tokens.sum_part("input").alias("input_tokens"), tokens.sum_part("output").alias("output_tokens"),
        tokens.sum_part("cache_read").alias("cache_read"),
        tokens.sum_part("cache_creation").alias("cache_creation"),
    )


def session_tools(ws: Workspace, session_id: str | None = None) -> DataFrame:
    return (
        _keyed(ws, session_id).where(F.col("tool_name").isNotNull())
        .groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("count"))
    )


def session_models(ws: Workspace, session_id: str | None = None) -> DataFrame:
    return (
        _keyed(ws, session_id).where(F.col("model").isNotNull())
        .groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("count"))
    )


def session_detail(ws: Workspace, session_id: str | None = None) -> DataFrame:
    """Summary plus active time, and new tokens (input + output) per changed line
    over all commits of the session. Entries, activity, tools and commits are the
    child tables."""
    keyed = Workspace(traces=_keyed(ws, session_id), git=ws.git)
    commits = (
        ws.git.where((F.col("event_type") == "commit") & F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("commits"),
             F.sum(F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("loc"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        session_summary(ws, session_id)
        .join(active_time(keyed), "session_id", "left").join(commits, "session_id", "left")
        .withColumn("active_ms", F.coalesce("active_ms", zero))
        .withColumn("commits", F.coalesce("commits", zero)).withColumn("loc", F.coalesce("loc", zero))
        .withColumn("new_tokens_per_loc",
                    F.when(F.col("loc") > 0, (F.col("input_tokens") + F.col("output_tokens")) / F.col("loc")))
    )


def session_entries(ws: Workspace, session_id: str | None = None, limit: int = 500) -> DataFrame:
    """First ``limit`` entries of each session in time order, long text cut."""
    rows = _keyed(ws, session_id).select(
        "session_id", "ts", "id", F.coalesce("entry_type", F.lit("")).alias("entry_type"),
        "tool_name", "model", "file_path", "command",
        F.substring("user_prompt", 1, V.TEXT_CHARS).alias("user_prompt"),
        F.substring("assistant_text", 1, V.TEXT_CHARS).alias("assistant_text"),
        F.col("usage.input").alias("input_tokens"), F.col("usage.output").alias("output_tokens"),
    )
    return top_n_per_group(rows, ["session_id"], [F.col("ts"), F.col("id")], limit, ["id"], "position")
