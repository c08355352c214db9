"""Slash prompts and skill tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import calls
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def _is_slash() -> Column:
    text = F.trim("user_prompt")
    return calls.is_user_message() & text.startswith("/") & (F.length(text) > 1)


def _first_word(text: Column) -> Column:
    """Up to the first plain space; tabs and newlines stay in the word."""
    return F.substring_index(text, " ", 1)


def _events(ws: Workspace, f: Filters) -> DataFrame:
    """Slash prompts and ``skill:`` calls as one stream of names. Tool and model
    filters do not apply. One scan: a row is one or the other."""
    base = Filters(days=f.days, project=f.project, agent=f.agent)
    typed = F.substring(_first_word(F.trim("user_prompt")), F.lit(2), F.lit(1 << 30))
    called = F.substring("tool_name", F.lit(7), F.lit(1 << 30))
    is_call = calls.is_tool_call() & F.lower("tool_name").startswith("skill:") & (F.length("tool_name") > 6)
    name = F.when(_is_slash(), typed).when(is_call, called)
    return (
        ws.trace_rows(base).select(name.alias("name"), "agent", "session_id", "project", "ts")
        .where(F.col("name") != "")
    )


def skill_usage(ws: Workspace, f: Filters = NO_FILTER, limit: int = 200) -> DataFrame:
    """Use per skill, typed and called together. Names that are not skill names
    (paths, pasted text) fall out after the limit, as they do in the original."""
    small = _events(ws, f).groupBy("name", "session_id", "project", "agent").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return (
        small.groupBy("name").agg(
            F.sum("n").alias("count"), F.countDistinct("session_id").alias("sessions"),
            F.countDistinct("project").alias("projects"),
            F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"),
            F.array_sort(F.collect_set("agent")).alias("agents"))
        .orderBy(F.desc("count"), "name").limit(limit)
        .where(F.col("name").rlike(V.CANONICAL_SKILL))
    )


def skill_sessions(ws: Workspace, name: str, f: Filters = NO_FILTER, limit: int = 200) -> DataFrame:
    return (
        _events(ws, f).where((F.col("name") == name) & F.col("session_id").isNotNull())
        .groupBy("session_id", "agent", "project")
        .agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .orderBy(F.desc("last_seen"), "session_id", "agent", "project").limit(limit)
    )


def slash_words(ws: Workspace, f: Filters = NO_FILTER, limit: int = 20) -> DataFrame:
    """First words of slash prompts, slash included."""
    return (
        ws.trace_rows(f, _is_slash()).groupBy(_first_word(F.trim("user_prompt")).alias("skill"))
        .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill").limit(limit)
    )
