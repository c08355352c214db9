"""The tables a query runs over, and the filters it takes."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import schema as S

GRANULARITIES = ("day", "week", "month")
ANY_MCP = "*mcp"


@dataclass(frozen=True)
class Filters:
    """Filters of the catalogue. Values are bound as literals, never as SQL text."""

    days: int | None = None
    project: str | None = None
    model: str | None = None
    tool: str | None = None
    agent: str | None = None
    granularity: str = "day"
    date: str | None = None

    def __post_init__(self):
        if self.days is not None and (isinstance(self.days, bool) or not isinstance(self.days, int) or self.days <= 0):
            raise ValueError(f"days must be a positive integer, got {self.days!r}")
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"granularity must be one of {GRANULARITIES}, got {self.granularity!r}")
        if self.date is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", self.date):
            raise ValueError(f"date must be YYYY-MM-DD, got {self.date!r}")


@dataclass(frozen=True)
class Workspace:
    """Tables plus the switches that change answers.

    ``parity``     some sub-lists (a tool's agents, a leak's agents) ignore the
                   active filters in the observed system; True keeps that.
    ``week_mode``  'parity' puts a Monday into the week before it, 'iso' does not.
    ``tool_agents``, ``pattern_agents``, ``session_patterns``
                   those sub-lists over all time, as the load writes them (see
                   plans/lake.py); without them, parity reads the narrow columns of
                   the whole table once more.
    ``today``      the date ``days`` counts back from; a parameter so that runs repeat.
    """

    traces: DataFrame | None = None
    git: DataFrame | None = None
    findings: DataFrame | None = None
    tool_agents: DataFrame | None = None
    pattern_agents: DataFrame | None = None
    session_patterns: DataFrame | None = None
    today: dt.date = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).date())
    parity: bool = True
    week_mode: str = "parity"

    @classmethod
    def of(cls, traces=None, git=None, findings=None, **kw) -> "Workspace":
        """Conform loosely typed inputs to the table schemas."""
        return cls(
            traces=None if traces is None else S.conform(traces, S.TRACES),
            git=None if git is None else S.conform(git, S.GIT_EVENTS),
            findings=None if findings is None else S.conform(findings, S.FINDINGS),
            **kw,
        )

    # ---- predicates -------------------------------------------------------
    def _since(self, df: DataFrame, f: Filters) -> Column:
        start = self.today - dt.timedelta(days=f.days)
        cond = F.col("ts") >= F.lit(start).cast("timestamp")
        if "event_date" in df.columns:
            # The partition column may follow local time, hence the day of slack.
            cond &= F.col("event_date") >= F.lit(start - dt.timedelta(days=1))
        return cond

    def trace_condition(self, f: Filters) -> Column:
        cond = F.col("ts").isNotNull()
        if f.days:
            cond &= self._since(self.traces, f)
        if f.project:
            cond &= F.col("project") == f.project
        if f.model:
            cond &= F.col("model") == f.model
        if f.tool == ANY_MCP:
            cond &= is_mcp(F.lower("tool_name"))
        elif f.tool:
            cond &= F.col("tool_name") == f.tool
        if f.agent:
            cond &= F.col("agent") == f.agent
        return cond

    def since_partition(self, f: Filters) -> DataFrame:
        """All traces filed on or after the first date of ``f``: what follows its rows
        (the result of a call, say) is among them, whatever the other filters."""
        if not f.days or "event_date" not in self.traces.columns:
            return self.traces
        return self.traces.where(F.col("event_date") >= F.lit(self.today - dt.timedelta(days=f.days + 1)))

    def trace_rows(self, f: Filters, *extra: Column) -> DataFrame:
        df = self.traces.where(self.trace_condition(f))
        for cond in extra:
            df = df.where(cond)
        return df

    def finding_condition(self, f: Filters) -> Column:
        """A single date wins over ``days``; tool and model do not apply."""
        cond = F.col("ts").isNotNull()
        if f.date:
            day = dt.date.fromisoformat(f.date)
            cond &= F.to_date("ts") == F.lit(day)
            if "event_date" in self.findings.columns:
                cond &= F.col("event_date").between(F.lit(day - dt.timedelta(days=1)), F.lit(day + dt.timedelta(days=1)))
        elif f.days:
            cond &= self._since(self.findings, f)
        if f.project:
            cond &= F.col("project") == f.project
        if f.agent:
            cond &= F.col("agent") == f.agent
        return cond

    def git_rows(self, f: Filters) -> DataFrame:
        """Commits; only ``days`` and ``project`` apply to git history."""
        cond = F.col("ts").isNotNull() & (F.col("event_type") == "commit")
        if f.days:
            cond &= self._since(self.git, f)
        if f.project:
            cond &= F.col("project") == f.project
        return self.git.where(cond)

    def comparison_rows(self, f: Filters) -> DataFrame:
        """Commits for before/after work: an agent filter restricts agent commits
        and leaves human ones in."""
        cond = (F.col("event_type") == "commit") & F.col("ts").isNotNull()
        if f.project:
            cond &= F.col("project") == f.project
        if f.agent:
            cond &= (~F.col("agent_authored")) | (F.col("agent_name") == f.agent)
        return self.git.where(cond)


def is_mcp(tool: Column) -> Column:
    return tool.startswith("mcp:") | tool.startswith("mcp__")
