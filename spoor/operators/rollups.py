"""Second-stage rollups over the session-level results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.operators import detectors as D
from spoor.operators import overview as O
from spoor.operators.skew import group_median
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def by_project(rows: DataFrame, metric: str, extra: tuple[str, ...] = (), cell: Column | None = None) -> DataFrame:
    """Per project: sessions, median and worst of a metric, sums of others.

    A histogram (project, value) is built once; sums, worst and median all read
    it, so the session-level query runs once and a hot project is spread over its
    values. Worst goes to the smallest session id among equals.
    """
    hist = (
        rows.where(F.col("project").isNotNull() & (F.col("project") != ""))
        .groupBy("project", metric)
        .agg(F.count(F.lit(1)).alias("n"), F.min("session_id").alias("holder"),
             *[F.sum(c).alias(f"sum_{c}") for c in extra])
    )
    cell = cell if cell is not None else F.floor(F.col(metric) / 1024)
    medians = group_median(hist.select("project", metric, "n"), ["project"], metric, "n", cell)
    return (
        hist.groupBy("project").agg(
            F.sum("n").alias("sessions"), F.max(metric).alias("worst"),
            F.max_by("holder", metric).alias("worst_session"), *[F.sum(f"sum_{c}").alias(c) for c in extra])
        .join(medians.select("project", "median"), "project")
        .select("project", "sessions", "median", "worst", "worst_session", *extra)
        .orderBy(F.desc("median"), F.desc("worst"), "project")
    )


def autonomy_summary(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Headline numbers; the median is the upper middle of tools per turn over
    sessions that used tools."""
    hist = (
        D.intervention_rate(ws, f, ordered=False)
        .groupBy(F.lit(1).alias("k"), "tools_per_turn")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("user_turns").alias("turns"))
    )
    active = hist.where(F.col("tools_per_turn") > 0)
    middle = group_median(active, ["k"], "tools_per_turn", "n", F.floor("tools_per_turn"))
    totals = hist.groupBy("k").agg(
        F.sum("n").alias("total"), F.sum("turns").alias("total_turns"),
        F.coalesce(F.sum(F.when(F.col("tools_per_turn") > 0, F.col("n"))), _zero()).alias("active_count"))
    # One group, one value: a scalar subquery, not a join.
    return totals.withColumn("upper", middle.select("upper").scalar()).select(
        "total", "total_turns", (F.col("total_turns") / F.col("total")).alias("avg_turns"),
        F.coalesce("upper", F.lit(0.0)).alias("median_tools_per_turn"), "active_count",
        (F.col("total") - F.col("active_count")).alias("chat_only"))


def autonomy_by_project(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return by_project(D.intervention_rate(ws, f, ordered=False), "user_turns", ("commits", "loc_delta"))


def _validation_counts() -> list[Column]:
    ok = F.col("validated_after_edit")
    return [
        F.count(F.lit(1)).alias("sessions"), F.count_if(ok).alias("validated"), F.count_if(~ok).alias("unvalidated"),
        F.coalesce(F.floor(100 * F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0)) + 0.5), _zero())
        .cast("bigint").alias("pct"),
        F.coalesce(F.sum(F.when(~ok, F.col("tokens"))), _zero()).alias("unvalidated_tokens"),
    ]


def validation_summary(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return D.validation_coverage(ws, f, ordered=False).agg(*_validation_counts())


def validation_by_project(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Worst is the costliest unvalidated session."""
    cost = F.when(~F.col("validated_after_edit"), F.struct((-F.col("tokens")).alias("t"), "session_id"))
    return (
        D.validation_coverage(ws, f, ordered=False).where(F.col("project").isNotNull() & (F.col("project") != ""))
        .groupBy("project").agg(*_validation_counts(), F.min(cost)["session_id"].alias("worst_session"))
        .orderBy("pct", F.desc("unvalidated_tokens"), "project")
    )


def loops_by_project(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    rows = D.validation_loops(ws, f, ordered=False).withColumn("fails", F.col("failures"))
    return by_project(rows, "failures", ("attempts", "fails"))


def productivity_summary(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    rows = D.productivity_rows(ws, f)
    return rows.agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("bucket") == b).alias(b.replace("-", "_")) for b in D.BUCKETS])


def productivity_by_project(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Median score, bucket counts and worst session; lowest median first."""
    hist = (
        D.productivity_rows(ws, f).where(F.col("project").isNotNull() & (F.col("project") != ""))
        .groupBy("project", "score").agg(
            F.count(F.lit(1)).alias("n"), F.min("session_id").alias("holder"),
            *[F.count_if(F.col("bucket") == b).alias(b.replace("-", "_")) for b in D.BUCKETS])
    )
    medians = group_median(hist.select("project", "score", "n"), ["project"], "score", "n", F.col("score"))
    return (
        hist.groupBy("project").agg(
            F.sum("n").alias("sessions"), *[F.sum(b.replace("-", "_")).alias(b.replace("-", "_")) for b in D.BUCKETS],
            F.min("score").alias("worst"), F.min_by("holder", "score").alias("worst_session"))
        .join(medians.select("project", "median"), "project").orderBy("median", "worst", "project")
    )


def ratio_by_project(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return by_project(D.search_to_edit(ws, f, ordered=False), "ratio", cell=F.floor(F.col("ratio") * 16))


def latency_by_project(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return by_project(D.first_action_latency(ws, f, ordered=False), "latency_ms")


def activity_pivot(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Date by agent tokens; cells without tokens stay NULL."""
    return (
        O.activity(ws, f, ordered=False).groupBy("date").pivot("agent", V.AGENTS)
        .agg(F.sum(F.when(F.col("total_tokens") > 0, F.col("total_tokens")))).orderBy("date")
    )


def heatmap_matrix(ws: Workspace, f: Filters = NO_FILTER, max_rows: int = 12) -> DataFrame:
    """Cells of the busiest projects with their dominant agent; the colour range
    (log10) spans all cells."""
    cells = (
        O.heatmap(ws, f, ordered=False).groupBy("project", "date").agg(
            F.sum("total_tokens").alias("tokens"),
            F.min_by("agent", F.struct((-F.col("total_tokens")).alias("t"), "agent")).alias("dominant_agent"))
    )
    top = (
        cells.groupBy("project").agg(F.sum("tokens").alias("project_tokens"))
        .orderBy(F.desc("project_tokens"), "project").limit(max_rows)
    )
    log = F.when(F.col("tokens") > 0, F.log10("tokens"))
    span = cells.agg(F.min(log).alias("lo"), F.max(log).alias("hi")).select(
        F.struct(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi")).alias("s"))
    return (
        cells.join(top, "project").withColumn("s", span.scalar())
        .select("project", "date", "tokens", "dominant_agent", "project_tokens", log.alias("log_tokens"),
                F.col("s.lo").alias("log_min"), F.col("s.hi").alias("log_max"))
        .orderBy(F.desc("project_tokens"), "project", "date")
    )


def token_totals(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return O.token_timeline(ws, f, ordered=False).agg(*[
        F.coalesce(F.sum(c), _zero()).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_creation")])


def models_with_tokens(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return O.models(ws, f, ordered=False).where(F.col("total_tokens") > 0)
