"""Friction detectors: loops, validation, autonomy, navigation, latency, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import calls, clock, tokens
from spoor.operators import sessions as SS
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def _has_session():
    return F.col("session_id").isNotNull()


def stumbles(ws: Workspace, f: Filters = NO_FILTER, limit: int = 25) -> DataFrame:
    """The same tool call repeated in one session. File-editing tools are left
    out: repeating those is how editing works."""
    shape = calls.loop_shape(F.col("command"), F.col("file_path"))
    first = F.struct("ts", "id")
    clusters = (
        ws.trace_rows(f, calls.is_tool_call(), _has_session(), F.col("tool_name").isNotNull(),
                      ~F.col("tool_name").isin(V.ITERATION_TOOLS))
        .withColumn("shape", shape).where(F.col("shape") != "")
        .groupBy("session_id", "tool_name", "shape")
        .agg(
            F.min_by("agent", first).alias("agent"), F.min_by("project", first).alias("project"),
            F.count(F.lit(1)).alias("occurrences"), tokens.sum_total().alias("tokens"),
            F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        )
        .where(F.col("occurrences") >= V.STUMBLE_THRESHOLD)
    )
    totals = ws.trace_rows(f, _has_session()).groupBy("session_id").agg(tokens.sum_total().alias("session_tokens"))
    return (
        clusters.join(totals, "session_id", "left")
        .select("session_id", "agent", "project", "tool_name", "shape", "occurrences", "tokens",
                F.coalesce("session_tokens", F.lit(0)).alias("session_tokens"), "first_at", "last_at")
        .orderBy(F.desc("occurrences"), F.desc("session_tokens"), "session_id", "tool_name", "shape").limit(limit)
    )


def _coverage(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("edits") > 0).withColumn(
        "validated_after_edit", F.coalesce(F.col("last_validation_at") > F.col("last_edit_at"), F.lit(False)))


def validation_coverage(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    """Sessions with an edit: was there a validation after the last one?
    Unvalidated first, then by tokens."""
    rows = (
        _coverage(SS.session_facts(ws, f))
        .select("session_id", "agent", "project", "started", "ended", "tokens",
                "last_edit_at", "last_validation_at", "validated_after_edit")
    )
    return rows.orderBy("validated_after_edit", F.desc("tokens"), "session_id") if ordered else rows


def _loops(ws: Workspace, f: Filters) -> DataFrame:
    runs = (
        ws.trace_rows(f, calls.is_validation(), F.col("tool_call_id").isNotNull())
        .groupBy("session_id", "tool_call_id", "command")
        .agg(F.min("agent").alias("agent"), F.max("project").alias("project"), F.min("ts").alias("call_at"))
    )
    # Outcome of a call: the success bit of its latest result.
    results = (
        ws.since_partition(f).where((F.col("entry_type") == "tool_result") & F.col("tool_call_id").isNotNull())
        .groupBy("tool_call_id")
        .agg(F.max_by("success", F.struct("ts", "id")).alias("success"), F.max("ts").alias("result_at"))
    )
    return (
        runs.join(results, "tool_call_id", "left")
        .groupBy("session_id", "command")
        .agg(
            F.min("agent").alias("agent"), F.max("project").alias("project"),
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(~F.col("success")).alias("failures"),
            F.min("call_at").alias("started_at"),
            F.coalesce(F.max("result_at"), F.max("call_at")).alias("ended_at"),
        )
        .where(F.col("attempts") >= V.LOOP_THRESHOLD)
        .select("session_id", "agent", "project", "command", "attempts", "failures", "started_at", "ended_at")
    )


def validation_loops(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    """One validation command run three times or more in a session."""
    rows = _loops(ws, f)
    return rows.orderBy(F.desc("failures"), F.desc("attempts"), "session_id", "command") if ordered else rows


def _autonomy(metrics: DataFrame) -> DataFrame:
    turns = F.col("user_turns")
    return (
        metrics.where(turns > 0)
        .withColumn("tools_per_turn", F.col("tool_calls") / turns)
        .withColumn("turns_per_commit", F.when(F.col("commits") > 0, turns / F.nullif("commits", F.lit(0))))
        .withColumn("turns_per_loc", F.when(F.col("loc_delta") > 0, turns / F.nullif("loc_delta", F.lit(0))))
    )


def intervention_rate(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    """How often the human stepped in, per session with a user turn."""
    rows = (
        _autonomy(SS.session_metrics(ws, f))
        .select("session_id", "agent", "project", "started", "ended", "user_turns", "tool_calls",
                "commits", "loc_delta", "tokens", "tools_per_turn", "turns_per_commit", "turns_per_loc")
    )
    return rows.orderBy(F.desc("user_turns"), "session_id") if ordered else rows


def search_to_edit(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    """Reads per edit, for sessions that edited."""
    rows = (
        SS.session_facts(ws, f).where(F.col("edits") > 0)
        .select("session_id", "agent", "project", "reads", "edits",
                (F.col("reads") / F.col("edits")).alias("ratio"), "started", "ended", "tokens")
    )
    return rows.orderBy(F.desc("ratio"), "session_id") if ordered else rows


def _with_latency(ws: Workspace, f: Filters, metrics: DataFrame) -> DataFrame:
    """``metrics`` with first_user_msg_at, first_action_at and latency_ms, NULL
    where a session has no such pair.

    Only a message at most two hours before the action counts, so each session
    looks into the hour slot of its action and the two before it: an equi-join on
    (session, slot) in place of a comparison with every message of the session.
    The metrics travel through the join, so they are computed once.
    """
    action = F.least("first_call_at", "first_commit_at")
    at = clock.ms(F.col("first_action_at"))
    slots = F.when(
        F.col("first_action_at").isNotNull(),
        F.sequence(clock.slot(at - V.MAX_LATENCY_MS), clock.slot(at)),
    ).otherwise(F.array(F.lit(None).cast("bigint")))
    probes = (
        metrics.withColumn("first_action_at", action)
        .select("session_id", "first_action_at", F.struct(*metrics.columns).alias("m"), F.explode(slots).alias("slot"))
    )
    # At most one row per millisecond: a slot stays bounded however busy it was.
    said = clock.ms(F.col("ts"))
    messages = (
        ws.trace_rows(f, calls.is_user_message(), _has_session())
        .groupBy(F.col("session_id").alias("s"), clock.slot(said).alias("t"), said.alias("said"))
        .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    )
    hit = (F.col("session_id") == F.col("s")) & (F.col("slot") == F.col("t")) & (F.col("lo") <= F.col("first_action_at"))
    msg_at = F.when(F.col("hi") <= F.col("first_action_at"), F.col("hi")).otherwise(F.col("lo"))
    latency = at - clock.ms(F.col("first_user_msg_at"))
    return (
        probes.join(messages, hit, "left")
        .groupBy("session_id").agg(
            F.any_value("m").alias("m"), F.max("first_action_at").alias("first_action_at"),
            F.max(msg_at).alias("first_user_msg_at"))
        .select("m.*", "first_action_at", "first_user_msg_at",
                F.when(latency.between(0, V.MAX_LATENCY_MS), latency).alias("latency_ms"))
    )


def first_action_latency(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    """Time from the last prompt before the first useful action (edit, validation
    or agent commit) to that action."""
    rows = (
        _with_latency(ws, f, SS.session_metrics(ws, f)).where(F.col("latency_ms").isNotNull())
        .select("session_id", "agent", "project", "first_user_msg_at", "first_action_at", "latency_ms", "tokens")
    )
    return rows.orderBy(F.desc("latency_ms"), "session_id") if ordered else rows


def productivity_rows(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Score, flags and bucket per session that edited or committed (unordered)."""
    metrics = _with_latency(ws, f, SS.session_metrics(ws, f)).withColumnRenamed("latency_ms", "first_action_ms")
    loops = _loops(ws, f).groupBy("session_id").agg(F.count(F.lit(1)).alias("stuck_loops"))
    edited, committed = F.col("edits") > 0, F.col("commits") >= 1
    rows = (
        metrics.where(edited | committed)
        .join(loops, "session_id", "left")
        .withColumn("stuck_loops", F.coalesce("stuck_loops", F.lit(0).cast("bigint")))
        .withColumn("validated_after_edit", F.when(
            edited, F.coalesce(F.col("last_validation_at") > F.col("last_edit_at"), F.lit(False))))
        .withColumn("tools_per_turn", F.when(F.col("user_turns") > 0,
                                             F.col("tool_calls") / F.nullif("user_turns", F.lit(0))))
        .withColumn("search_to_edit_ratio", F.when(edited, F.col("reads") / F.nullif("edits", F.lit(0))))
    )
    # flag -> (condition, penalty)
    stuck = F.col("stuck_loops")
    red = [
        ("no-validation", ~F.col("validated_after_edit"), F.lit(8)),
        ("stuck-loops", stuck >= 1, F.least(stuck * 8, F.lit(24))),
        ("high-intervention", F.col("user_turns") >= V.HIGH_INTERVENTION_TURNS, F.lit(8)),
        ("high-search-ratio", F.col("search_to_edit_ratio") >= V.HIGH_SEARCH_RATIO, F.lit(6)),
        ("slow-first-action", F.col("first_action_ms") >= V.SLOW_FIRST_ACTION_MS, F.lit(5)),
        ("dark-spend",
         (F.col("tokens") >= V.DARK_SPEND_TOKENS) & (F.col("loc_delta") <= V.DARK_SPEND_LOC), F.lit(12)),
    ]
    green = [
        ("shipped-commit", committed, F.least(F.col("commits"), F.lit(5)) * 6),
        ("validated", F.col("validated_after_edit"), F.lit(10)),
    ]
    raw = F.lit(50) + F.least(F.col("loc_delta") / 200, F.lit(8.0))
    for _, cond, points in green:
        raw = raw + F.when(cond, points).otherwise(0)
    for _, cond, points in red:
        raw = raw - F.when(cond, points).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5))).cast("int")
    bucket = (
        F.when(committed & (F.col("score") >= V.PRODUCTIVE_SCORE), "productive")
        .when(committed, "expensive-but-productive")
        .when(stuck >= 1, "stuck")
        .otherwise("needs-better-setup")
    )
    return (
        rows
        .withColumn("red_flags", F.array_compact(F.array(*[F.when(c, name) for name, c, _ in red])))
        .withColumn("green_flags", F.array_compact(F.array(*[F.when(c, name) for name, c, _ in green])))
        .withColumn("score", score).withColumn("bucket", bucket)
        .select(
            "session_id", "agent", "project", "started", "ended", "tokens", "commits", "loc_delta", "user_turns",
            "tools_per_turn", "validated_after_edit", "stuck_loops", "search_to_edit_ratio", "first_action_ms",
            "red_flags", "green_flags", "bucket", "score",
        )
    )


BUCKETS = ["productive", "expensive-but-productive", "stuck", "needs-better-setup"]


def productivity_score(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Composite score, best bucket first."""
    rank = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    return productivity_rows(ws, f).orderBy(rank, F.desc("score"), F.desc("tokens"), "session_id")
