"""Counts over traces: totals, timelines, tools, models, projects, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions import calls, clock, tokens
from spoor.functions.tokens import n_rows
from spoor.operators.skew import top_n_per_group
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def _bucket(ws: Workspace, f: Filters):
    return clock.bucket(F.col("ts"), f.granularity, ws.week_mode).alias("date")


def stats(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Grand totals. The three distinct counts run over pre-aggregated rows, not
    over the raw table."""
    small = ws.trace_rows(f).groupBy("session_id", "project", F.to_date("ts").alias("day")).agg(
        n_rows().alias("n"), *[F.sum(f"usage.{p}").alias(p) for p in ("input", "output", "cache_read", "cache_creation")])
    zero = F.lit(0).cast("bigint")
    return small.agg(
        F.coalesce(F.sum("n"), zero).alias("total_entries"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.countDistinct("project").alias("total_projects"),
        F.countDistinct("day").alias("total_days"),
        F.coalesce(F.sum("input"), zero).alias("total_input_tokens"),
        F.coalesce(F.sum("output"), zero).alias("total_output_tokens"),
        F.coalesce(F.sum("cache_read"), zero).alias("total_cache_read"),
        F.coalesce(F.sum("cache_creation"), zero).alias("total_cache_creation"),
    )


def activity(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    rows = (
        ws.trace_rows(f).groupBy(_bucket(ws, f), "agent")
        .agg(n_rows().alias("count"), tokens.sum_total().alias("total_tokens"))
    )
    return rows.orderBy("date", "agent") if ordered else rows


def heatmap(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    rows = (
        ws.trace_rows(f, F.col("project").isNotNull()).groupBy(_bucket(ws, f), "project", "agent")
        .agg(tokens.sum_total().alias("total_tokens"))
    )
    return rows.orderBy("date", "project", "agent") if ordered else rows


def token_timeline(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    rows = (
        ws.trace_rows(f, F.col("usage").isNotNull()).groupBy(_bucket(ws, f))
        .agg(tokens.sum_part("input").alias("input_tokens"), tokens.sum_part("output").alias("output_tokens"),
             tokens.sum_part("cache_read").alias("cache_read"),
             tokens.sum_part("cache_creation").alias("cache_creation"))
    )
    return rows.orderBy("date") if ordered else rows


def tool_agents(traces: DataFrame) -> DataFrame:
    """Rows per tool and agent, over all time."""
    return traces.where(F.col("tool_name").isNotNull()).groupBy("tool_name", "agent").agg(n_rows().alias("n"))


def tools(ws: Workspace, f: Filters = NO_FILTER, limit: int = 25) -> DataFrame:
    """Tools by use, with the agent that uses each most and all agents that do.
    In parity mode those two ignore the filters. With a date filter, the tools are chosen
    from its dates alone, and their agents are then looked up."""
    if ws.parity and f.days:
        best = ws.trace_rows(f, F.col("tool_name").isNotNull()).groupBy("tool_name").agg(n_rows().alias("count"))
        best = best.orderBy(F.desc("count"), "tool_name").limit(limit)
        use = ws.tool_agents if ws.tool_agents is not None else tool_agents(ws.traces)
        return (
            best.join(use, "tool_name").groupBy("tool_name", "count")
            .agg(F.min_by("agent", F.struct((-F.col("n")).alias("n"), "agent")).alias("primary_agent"),
                 F.array_sort(F.collect_set("agent")).alias("agents"))
            .orderBy(F.desc("count"), "tool_name")
        )
    keep = ws.trace_condition(f) & F.col("tool_name").isNotNull()
    rows = ws.traces.where(F.col("tool_name").isNotNull()) if ws.parity else ws.traces.where(keep)
    per_agent = rows.groupBy("tool_name", "agent").agg(F.count_if(keep).alias("kept"), n_rows().alias("n"))
    return (
        per_agent.groupBy("tool_name")
        .agg(
            F.sum("kept").alias("count"),
            # Most rows wins; equal counts go to the smaller name.
            F.min_by("agent", F.struct((-F.col("n")).alias("n"), "agent")).alias("primary_agent"),
            F.array_sort(F.collect_set("agent")).alias("agents"),
        )
        .where(F.col("count") > 0)
        .orderBy(F.desc("count"), "tool_name").limit(limit)
    )


def motifs(ws: Workspace, f: Filters = NO_FILTER, limit: int = 25) -> DataFrame:
    """(tool, coarse shape) pairs that repeat, across sessions."""
    shape = calls.motif_shape(F.col("tool_name"), F.col("command"), F.col("file_path"))
    return (
        ws.trace_rows(f, calls.is_tool_call(), F.col("tool_name").isNotNull())
        .groupBy("tool_name", shape.alias("shape"))
        .agg(n_rows().alias("occurrences"), F.countDistinct("session_id").alias("sessions"),
             tokens.sum_total().alias("tokens"))
        .where(F.col("occurrences") >= 2)
        .orderBy(F.desc("occurrences"), F.desc("tokens"), "tool_name", "shape").limit(limit)
    )


def projects(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return (
        ws.trace_rows(f, F.col("project").isNotNull()).groupBy("project")
        .agg(n_rows().alias("entries"), F.countDistinct("session_id").alias("sessions"),
             tokens.sum_part("output").alias("output_tokens"), tokens.sum_total().alias("total_tokens"))
        .orderBy(F.desc("total_tokens"), "project")
    )


def models(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    rows = (
        ws.trace_rows(f, F.col("model").isNotNull()).groupBy("model")
        .agg(n_rows().alias("count"), tokens.sum_total().alias("total_tokens"))
    )
    return rows.orderBy(F.desc("total_tokens"), "model") if ordered else rows


def tool_detail(ws: Workspace, f: Filters = NO_FILTER, tool: str | None = None, top: int = 15) -> DataFrame:
    """Breakdown of every tool, or of one, as rows (tool_name, dimension, value,
    count): totals, dates, agents, projects, models, and the top commands and
    files. One scan; the dimensions are counted together."""
    rows = ws.trace_rows(f, F.col("tool_name").isNotNull())
    if tool:
        rows = rows.where(F.col("tool_name") == tool)
    dims = {
        "total": F.lit(""),
        "date": clock.bucket(F.col("ts"), f.granularity, ws.week_mode).cast("string"),
        "agent": F.col("agent"), "project": F.col("project"), "model": F.col("model"),
        "command": F.col("command"), "file": F.col("file_path"),
    }
    counted = (
        rows.select("tool_name", F.inline(F.array(*[
            F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in dims.items()])))
        .where(F.col("value").isNotNull())
        .groupBy("tool_name", "dimension", "value").agg(n_rows().alias("count"))
    )
    ranked = F.col("dimension").isin("command", "file")
    best = top_n_per_group(counted.where(ranked), ["tool_name", "dimension"],
                           [F.desc("count"), F.col("value")], top, ["value"]).drop("rank")
    return counted.where(~ranked).unionByName(best)


def _values(ws: Workspace, column: str) -> DataFrame:
    return ws.traces.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def project_list(ws: Workspace) -> DataFrame:
    return _values(ws, "project")


def model_list(ws: Workspace) -> DataFrame:
    return _values(ws, "model")


def agent_list(ws: Workspace) -> DataFrame:
    return _values(ws, "agent")


def tool_list(ws: Workspace) -> DataFrame:
    return _values(ws, "tool_name")


def census(ws: Workspace) -> DataFrame:
    """Entries per agent and project, without writing anything."""
    return ws.traces.groupBy("agent", "project").agg(n_rows().alias("entries"))
