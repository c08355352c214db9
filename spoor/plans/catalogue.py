"""Every query of the catalogue over the derived test tables.

Each entry takes (spark, directory) and returns a DataFrame over whole tables.
Results are cast to plain types, so that another engine can be compared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor import session
from spoor.operators import attribution as A
from spoor.operators import commits as C
from spoor.operators import detectors as D
from spoor.operators import governance as G
from spoor.operators import overview as O
from spoor.operators import permissions as P
from spoor.operators import rollups as U
from spoor.operators import security as X
from spoor.operators import sessions as S
from spoor.operators import skills as K
from spoor.plans import loads, samples, streams, views
from spoor.workspace import Filters, Workspace

Query = Callable[[SparkSession, str], DataFrame]

TODAY = dt.date(2024, 1, 31)
CUTOFF = "2024-01-15"


def portable(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, doubles rounded, text arrays joined."""

    def plain(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def _ws(fn: Callable[[Workspace], DataFrame], linked: bool = True, **kw) -> Query:
    return lambda spark, sf_dir: portable(fn(views.workspace(spark, sf_dir, linked, today=TODAY, **kw)))


def _raw(fn: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(session.configure(spark), sf_dir))

    return run


def _linked(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """Run ``fn`` after the commits without a session were linked."""
    return lambda ws: fn(Workspace(traces=ws.traces, git=A.link_commits(ws.git, ws.traces),
                                   findings=ws.findings, today=ws.today))


def _links(pairs: DataFrame, col: str, **fields: str) -> DataFrame:
    return pairs.select("commit_sha", *[F.col(f"{col}.{k}" if k else col).alias(v) for v, k in fields.items()])


WEEK, MONTH = Filters(granularity="week"), Filters(granularity="month")

WORKSPACE_QUERIES: dict[str, Query] = {
    # overview
    "stats": _ws(O.stats),
    "stats_last_7_days": _ws(lambda w: O.stats(w, Filters(days=7))),
    "stats_one_project_agent": _ws(lambda w: O.stats(w, Filters(project="p3", agent="codex"))),
    "stats_model_tool": _ws(lambda w: O.stats(w, Filters(model="m1", tool="Read"))),
    "stats_any_mcp": _ws(lambda w: O.stats(w, Filters(tool="*mcp"))),
    "activity": _ws(O.activity),
    "activity_by_week": _ws(lambda w: O.activity(w, WEEK)),
    "activity_by_iso_week": _ws(lambda w: O.activity(w, WEEK), week_mode="iso"),
    "activity_by_month": _ws(lambda w: O.activity(w, MONTH)),
    "heatmap": _ws(O.heatmap),
    "token_timeline": _ws(O.token_timeline),
    "tools": _ws(O.tools),
    "tools_last_7_days": _ws(lambda w: O.tools(w, Filters(days=7))),
    "tools_filtered_parity": _ws(lambda w: O.tools(w, Filters(project="p3"))),
    "tools_filtered_strict": _ws(lambda w: O.tools(w, Filters(project="p3")), parity=False),
    "motifs": _ws(O.motifs),
    "projects": _ws(O.projects),
    "models": _ws(O.models),
    "tool_detail": _ws(O.tool_detail),
    "project_list": _ws(O.project_list),
    "model_list": _ws(O.model_list),
    "agent_list": _ws(O.agent_list),
    "tool_list": _ws(O.tool_list),
    "source_census": _ws(O.census),
    # sessions
    "sessions": _ws(S.sessions),
    "sessions_with_tool_and_model": _ws(lambda w: S.sessions(w, Filters(tool="skill:ship", model="m2", agent="codex"))),
    "session_rollups": _ws(S.rollups),
    "dark_spend": _ws(S.dark_spend),
    "zero_code": _ws(S.zero_code),
    "active_time": _ws(S.active_time),
    "session_activity": _ws(S.session_activity),
    "session_summary": _ws(S.session_summary),
    "session_tools": _ws(S.session_tools),
    "session_models": _ws(S.session_models),
    "session_detail": _ws(S.session_detail),
    "session_entries": _ws(S.session_entries),
    "idle_segments": _ws(S.idle_segments),
    # detectors
    "stumbles": _ws(D.stumbles),
    "validation_coverage": _ws(D.validation_coverage),
    "validation_loops": _ws(D.validation_loops),
    "validation_loops_last_7_days": _ws(lambda w: D.validation_loops(w, Filters(days=7))),
    "intervention_rate": _ws(D.intervention_rate),
    "search_to_edit": _ws(D.search_to_edit),
    "first_action_latency": _ws(D.first_action_latency),
    "productivity_score": _ws(D.productivity_score),
    "productivity_score_linked": _ws(_linked(D.productivity_score), linked=False),
    # skills
    "skill_usage": _ws(K.skill_usage),
    "skill_sessions": _ws(lambda w: K.skill_sessions(w, "ship")),
    "slash_words": _ws(K.slash_words),
    # findings
    "findings": _ws(lambda w: w.findings),
    "findings_by_pattern": _ws(X.findings_by_pattern),
    "findings_by_pattern_one_day": _ws(lambda w: X.findings_by_pattern(w, Filters(date="2024-01-10", days=3))),
    "findings_timeline": _ws(X.findings_timeline),
    "findings_by_session": _ws(X.findings_by_session),
    "findings_by_session_last_7_days": _ws(lambda w: X.findings_by_session(w, Filters(days=7))),
    "findings_by_pattern_last_7_days": _ws(lambda w: X.findings_by_pattern(w, Filters(days=7))),
    "findings_pivot": _ws(lambda w: X.findings_pivot(w, ["github_token", "openai_key"])),
    # git
    "git_stats": _ws(C.git_stats),
    "git_coverage": _ws(C.coverage),
    "attribution_by_project": _ws(C.attribution_by_project),
    "attribution_gaps": _ws(C.attribution_gaps),
    "git_timeline": _ws(C.git_timeline),
    "git_timeline_by_week": _ws(lambda w: C.git_timeline(w, WEEK)),
    "unlinked_agent_commits": _ws(lambda w: C.unlinked_agent_commits(w, "p9")),
    "git_commits": _ws(C.git_commits),
    "commit_detail": _ws(C.commit_detail),
    "session_commits": _ws(C.session_commits),
    "git_sessions": _ws(C.git_sessions),
    "git_session_commits": _ws(lambda w: C.git_session_commits(w, Filters(days=10))),
    "comparison_timeline": _ws(C.comparison_timeline),
    "comparison_timeline_one_agent": _ws(lambda w: C.comparison_timeline(w, Filters(agent="codex"))),
    "comparison_range": _ws(C.comparison_range),
    "comparison": _ws(lambda w: C.comparison(w, CUTOFF)),
    "comparison_same_repos": _ws(lambda w: C.comparison(w, "2024-01-02", same_repos_only=True)),
    "comparison_by_day": _ws(lambda w: C.comparison(w, "2024-03-01", by_day=True, empty="null")),
    "comparison_repos": _ws(lambda w: C.comparison_repos(w, "2024-01-02")),
    "commit_density": _ws(C.commit_density),
    # attribution
    "session_windows": _ws(lambda w: A.session_windows(w.traces)),
    "attribute_at_scan": _ws(
        lambda w: A.attribute_at_scan(w.git, w.traces).select("commit_sha", "agent_authored", "agent_name", "session_id"),
        linked=False),
    "window_links": _ws(
        lambda w: _links(A.window_links(w.git, w.traces), "win", session_id="session_id", agent="agent"), linked=False),
    "activity_links": _ws(
        lambda w: _links(A.activity_links(w.git, w.traces), "near_session", session_id=""), linked=False),
    "link_commits": _ws(
        lambda w: A.link_commits(w.git, w.traces).select("commit_sha", "agent_name", "session_id"), linked=False),
    "git_stats_linked": _ws(_linked(C.git_stats), linked=False),
    "filter_author": _ws(lambda w: A.filter_author(w.git, "DEV 3").select("commit_sha", "author")),
    "latest_repo_local": _ws(lambda w: P.latest_repo_local(w.git)),
    # permissions
    "permissions": _ws(P.permissions),
    "permission_candidates": _ws(lambda w: P.candidates(P.permissions(w), "verb")),
    "permission_candidates_sub": _ws(lambda w: P.candidates(P.permissions(w), "sub")),
    # second-stage rollups
    "autonomy_summary": _ws(U.autonomy_summary),
    "autonomy_by_project": _ws(U.autonomy_by_project),
    "validation_summary": _ws(U.validation_summary),
    "validation_by_project": _ws(U.validation_by_project),
    "loops_by_project": _ws(U.loops_by_project),
    "productivity_summary": _ws(U.productivity_summary),
    "productivity_by_project": _ws(U.productivity_by_project),
    "ratio_by_project": _ws(U.ratio_by_project),
    "latency_by_project": _ws(U.latency_by_project),
    "activity_pivot": _ws(U.activity_pivot),
    "heatmap_matrix": _ws(U.heatmap_matrix),
    "token_totals": _ws(U.token_totals),
    "models_with_tokens": _ws(U.models_with_tokens),
    # governance
    "disclose_basic": _ws(lambda w: G.disclose(w.traces, "basic").agg(
        *[F.count(c).alias(c) for c in ("id", "tool_name", "tool_call_id", "command", "user_prompt")])),
    "disclose_moderate": _ws(lambda w: G.disclose(w.traces, "moderate").agg(
        *[F.count(c).alias(c) for c in ("id", "tool_name", "tool_call_id", "command", "user_prompt")])),
    "disclose_git_basic": _ws(lambda w: G.disclose_git(w.git, "basic").agg(
        *[F.count(c).alias(c) for c in ("commit_sha", "author", "message", "session_id", "repo_local")])),
    "field_policy": _ws(lambda w: G.apply_policy(w.traces, {**G.default_policy("full"), "command": False}).agg(
        *[F.count(c).alias(c) for c in ("command", "file_path", "user_prompt")])),
    "anonymise": _ws(lambda w: G.anonymise(w.traces).groupBy("developer", "machine").agg(
        F.count(F.lit(1)).alias("entries"))),
    "git_event_ids": _ws(lambda w: w.git.select(
        "commit_sha", G.git_event_id(F.col("repo"), F.col("event_type"), F.col("commit_sha")).alias("id"),
        G.partition_hash(F.col("repo")).alias("repo_hash"))),
}


def queries() -> dict[str, Query]:
    return {**WORKSPACE_QUERIES, **{k: _raw(v) for k, v in {**samples.QUERIES, **streams.QUERIES, **loads.QUERIES}.items()}}
