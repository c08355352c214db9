"""Which agent wrote a commit, and which session produced it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import calls, clock
from spoor.operators import intervals

KEY = ["repo_key", "commit_sha"]


def detect_agent(co_authors: Column, author_email: Column) -> Column:
    """struct(agent_authored, agent_name): co-author trailers in order, then the
    author's address; the first pattern that matches decides."""

    def first_of(text: Column, patterns: list[tuple[str, str]]) -> Column:
        return F.coalesce(*[F.when(text.rlike("(?i)" + rx), agent) for rx, agent in patterns])

    by_trailer = F.get(F.array_compact(F.transform(
        co_authors, lambda c: first_of(c, V.COAUTHOR_AGENT_PATTERNS))), 0)
    name = F.coalesce(by_trailer, first_of(author_email, V.AUTHOR_AGENT_PATTERNS))
    return F.struct(name.isNotNull().alias("agent_authored"), name.alias("agent_name"))


def session_windows(traces: DataFrame, padding_ms: int = V.SESSION_PADDING_MS) -> DataFrame:
    """Padded activity window per (project, session), in milliseconds."""
    at = clock.ms(F.col("ts"))
    return (
        traces.where(F.col("session_id").isNotNull() & F.col("project").isNotNull() & F.col("ts").isNotNull())
        .groupBy("project", "session_id")
        .agg(F.min("agent").alias("agent"), (F.min(at) - padding_ms).alias("start_ms"),
             (F.max(at) + padding_ms).alias("end_ms"))
    )


def _keyed(git: DataFrame) -> DataFrame:
    return git.withColumn("repo_key", F.coalesce("repo", F.lit(""))).withColumn("at_ms", clock.ms(F.col("ts")))


def match_windows(commits: DataFrame, windows: DataFrame, by_start: bool) -> DataFrame:
    """First window of the commit's project that holds it: repo_key, commit_sha,
    win(session_id, agent). Order: earliest start, or smallest session id."""
    best = F.struct(*(["start_ms"] if by_start else []), "session_id", "agent")
    found = intervals.first_covering(
        commits, windows.withColumn("win", best), "project", "at_ms", "start_ms", "end_ms", "win")
    return (
        commits.select(*KEY, "project", "at_ms").join(found, ["project", "at_ms"])
        .groupBy(*KEY).agg(F.min("win").alias("win"))
    )


def attribute_at_scan(git: DataFrame, traces: DataFrame) -> DataFrame:
    """Scan-time rule: any commit without a session that falls into a window of
    its project joins that session. Human commits turn agent-authored, trailers
    keep their agent."""
    commits = _keyed(git)
    orphans = commits.where(F.col("session_id").isNull() & F.col("project").isNotNull() & F.col("ts").isNotNull())
    links = match_windows(orphans, session_windows(traces), by_start=True)
    linked = commits.join(links, KEY, "left")
    take = F.col("session_id").isNull() & F.col("win").isNotNull()
    promote = take & ~F.coalesce("agent_authored", F.lit(False))
    return linked.select(*[
        {
            "session_id": F.when(take, F.col("win.session_id")).otherwise(F.col("session_id")),
            "agent_name": F.when(promote, F.col("win.agent")).otherwise(F.col("agent_name")),
            "agent_authored": F.when(promote, F.lit(True)).otherwise(F.col("agent_authored")),
        }.get(c, F.col(c)).alias(c)
        for c in git.columns
    ])


def window_links(git: DataFrame, traces: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Load-time pass one: agent-authored orphans and the window that takes them. ``windows``
    are those of all sessions, if they are at hand."""
    orphans = _keyed(git).where(
        F.col("session_id").isNull() & F.col("project").isNotNull() & F.col("agent_authored") & F.col("ts").isNotNull())
    return match_windows(orphans, session_windows(traces) if windows is None else windows, by_start=False)


def activity_links(git: DataFrame, traces: DataFrame, within_ms: int = V.ACTIVITY_WINDOW_MS) -> DataFrame:
    """Load-time pass two: agent-authored orphans and the session of the same
    agent whose tool call lies nearest, in any project. A tie leaves the orphan."""
    orphans = _keyed(git).where(
        F.col("session_id").isNull() & F.col("agent_authored") & F.col("agent_name").isNotNull() & F.col("ts").isNotNull()
    ).withColumnRenamed("agent_name", "agent")
    marks = traces.where(calls.is_tool_call() & F.col("session_id").isNotNull() & F.col("ts").isNotNull()).select(
        "agent", clock.ms(F.col("ts")).alias("mark_ms"), F.col("session_id").alias("near_session"))
    found = intervals.nearest_unique(orphans, marks, "agent", "at_ms", "mark_ms", "near_session", within_ms)
    return (
        orphans.select(*KEY, "agent", "at_ms").join(found, ["agent", "at_ms"])
        .groupBy(*KEY).agg(F.min("near_session").alias("near_session"))
    )


#: What ``link_commits`` notes of a commit whose agent came from the window too.
FILLED = "window+agent"


def link_commits(git: DataFrame, traces: DataFrame, windows: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """Fill the session of agent-authored commits: window pass, then nearest
    activity for what is left. Human commits are never promoted. ``mark`` names a column
    that tells which pass linked a commit (NULL: none did).

    Neither pass reads the other's result: both run over all orphans and the window
    wins. That costs the second pass a few more points and saves running the first
    one twice.
    """
    orphan = F.col("agent_authored") & F.col("session_id").isNull()
    new = {
        "session_id": F.coalesce("session_id", F.when(orphan, F.coalesce("win.session_id", "near_session"))),
        "agent_name": F.coalesce("agent_name", F.when(orphan, F.col("win.agent"))),
    }
    names = list(git.columns)
    if mark:
        by = F.when(F.col("win").isNotNull(), F.when(F.col("agent_name").isNull() & F.col("win.agent").isNotNull(), FILLED).otherwise("window"))
        new[mark] = F.when(orphan, F.coalesce(by, F.when(F.col("near_session").isNotNull(), "activity")))
        names += [mark] if mark not in names else []
    return (
        _keyed(git).join(window_links(git, traces, windows), KEY, "left").join(activity_links(git, traces), KEY, "left")
        .select(*[new.get(c, F.col(c)).alias(c) for c in names])
    )


def filter_author(git: DataFrame, developer: str | None) -> DataFrame:
    """Keep commits whose author name or address holds ``developer``."""
    if not developer:
        return git
    who = developer.lower()
    return git.where(
        F.lower(F.coalesce("author", F.lit(""))).contains(who)
        | F.lower(F.coalesce("author_email", F.lit(""))).contains(who))
