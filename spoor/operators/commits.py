"""Git queries and before/after comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import calls, clock, tokens
from spoor.operators.skew import group_median
from spoor.workspace import Filters, Workspace

NO_FILTER = Filters()


def _agent() -> Column:
    return F.col("agent_authored")


def _linked() -> Column:
    return F.col("session_id").isNotNull()


def _attribution_counts() -> list[Column]:
    return [
        F.count_if(_agent()).alias("agent_commits"),
        F.count_if(_agent() & _linked()).alias("linked_agent_commits"),
        F.count_if(_agent() & ~_linked()).alias("unlinked_agent_commits"),
    ]


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def git_stats(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return ws.git_rows(f).agg(
        F.count(F.lit(1)).alias("total_commits"),
        *_attribution_counts(),
        F.count_if(~_agent()).alias("human_commits"),
        _total("insertions").alias("total_insertions"),
        _total("deletions").alias("total_deletions"),
        F.coalesce(F.sum(F.when(_agent(), F.col("insertions"))), F.lit(0)).alias("agent_insertions"),
        _total("files_changed").alias("files_changed"),
        F.countDistinct("repo").alias("repos"),
    )


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.floor(100 * part / F.nullif(whole, F.lit(0)) + 0.5), F.lit(0)).cast("bigint")


def coverage(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Share of agent commits, and of those linked to a session, in percent."""
    s = git_stats(ws, f)
    return s.select(
        _pct(s.agent_commits, s.total_commits).alias("agent_pct"),
        _pct(s.linked_agent_commits, s.agent_commits).alias("linked_pct"))


def attribution_by_project(ws: Workspace, f: Filters = NO_FILTER, ordered: bool = True) -> DataFrame:
    """Projects with agent commits, most unlinked first."""
    rows = (
        ws.git_rows(f).where(F.col("project").isNotNull()).groupBy("project").agg(*_attribution_counts())
        .where(F.col("agent_commits") > 0)
    )
    return rows.orderBy(F.desc("unlinked_agent_commits"), F.desc("agent_commits"), "project") if ordered else rows


def attribution_gaps(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Projects where some agent commit has no session, with linked share."""
    return (
        attribution_by_project(ws, f).where(F.col("unlinked_agent_commits") > 0)
        .withColumn("coverage_pct", _pct(F.col("linked_agent_commits"), F.col("agent_commits")))
    )


def git_timeline(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return (
        ws.git_rows(f).groupBy(clock.bucket(F.col("ts"), f.granularity, ws.week_mode).alias("date"))
        .agg(F.count_if(_agent()).alias("agent_commits"), F.count_if(~_agent()).alias("human_commits"),
             _total("insertions").alias("insertions"), _total("deletions").alias("deletions"))
        .orderBy("date")
    )


def _commit_columns(default_text: bool = True) -> list[Column]:
    text = (lambda c: F.coalesce(c, F.lit("")).alias(c)) if default_text else F.col
    zero = F.lit(0).cast("bigint")
    return [
        F.col("commit_sha"), F.col("ts"), F.col("project"), F.col("repo"), F.col("branch"),
        text("author"), text("message"),
        *[F.coalesce(c, zero).alias(c) for c in ("files_changed", "insertions", "deletions")],
        F.coalesce("agent_authored", F.lit(False)).alias("agent_authored"),
        F.col("agent_name"), F.col("session_id"),
    ]


def unlinked_agent_commits(ws: Workspace, project: str, f: Filters = NO_FILTER, limit: int = 100) -> DataFrame:
    return (
        ws.git_rows(f).where(_agent() & ~_linked() & (F.col("project") == project))
        .select(*_commit_columns()).orderBy(F.desc("ts"), "repo", "commit_sha").limit(limit)
    )


def git_commits(ws: Workspace, f: Filters = NO_FILTER, limit: int = 50) -> DataFrame:
    return ws.git_rows(f).select(*_commit_columns()).orderBy(F.desc("ts"), "repo", "commit_sha").limit(limit)


def commit_detail(ws: Workspace, sha: str | None = None, repo: str | None = None) -> DataFrame:
    """Commits with body and files; those of one ``sha`` or of one repository if given. A sha
    may be in several repositories: each has its row."""
    rows = ws.git.where(F.col("commit_sha") == sha) if sha else ws.git
    if repo is not None:
        rows = rows.where(F.coalesce("repo", F.lit("")) == repo)
    return rows.select(
        *_commit_columns(), F.col("message_body"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def session_commits(ws: Workspace, session_id: str | None = None) -> DataFrame:
    """Commits linked to a session, oldest first; every session's when none given."""
    rows = ws.git.where(_linked() & (F.col("event_type") == "commit"))
    if session_id:
        rows = rows.where(F.col("session_id") == session_id)
    return rows.select(*_commit_columns(default_text=False)).orderBy("session_id", "ts", "commit_sha")


def _committing(ws: Workspace, f: Filters) -> DataFrame:
    return ws.git_rows(f).where(_linked()).select("session_id").distinct()


def git_sessions(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Sessions that committed in the window, with whole-session totals, newest
    first. Their commits are the child table ``git_session_commits``."""
    ids = _committing(ws, f)
    commits = (
        ws.git.where(_linked() & (F.col("event_type") == "commit"))
        .groupBy("session_id").agg(F.count(F.lit(1)).alias("commits"))
    )
    return (
        ws.traces.join(ids, "session_id", "left_semi").groupBy("session_id", "agent")
        .agg(
            F.max("project").alias("project"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
            F.count(F.lit(1)).alias("entries"),
            tokens.sum_part("input").alias("input_tokens"), tokens.sum_part("output").alias("output_tokens"),
            tokens.sum_part("cache_read").alias("cache_read"))
        .withColumn("duration_ms", F.coalesce(
            F.greatest(F.lit(0), clock.ms(F.col("ended")) - clock.ms(F.col("started"))), F.lit(0)))
        .join(commits, "session_id", "left")
        .orderBy(F.desc("started"), "session_id", "agent")
    )


def git_session_commits(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    return (
        ws.git.where(F.col("event_type") == "commit").join(_committing(ws, f), "session_id", "left_semi")
        .select(*_commit_columns(default_text=False)).orderBy("session_id", "ts", "commit_sha")
    )


# ---- before / after -----------------------------------------------------------

def _local_day() -> Column:
    """Calendar day as the author's clock had it."""
    return F.substring("timestamp_text", 1, 10)


def _slim(rows: DataFrame) -> DataFrame:
    files = F.coalesce("files", F.array().cast("array<string>"))
    return rows.select(
        "commit_sha", "timestamp_text", "ts", _local_day().alias("day"), F.coalesce("project", F.lit("")).alias("project"),
        (F.coalesce("insertions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("loc_delta"),
        F.size(files).cast("bigint").alias("n_files"),
        F.exists(files, calls.is_test_path).alias("has_test"),
        F.coalesce("agent_authored", F.lit(False)).alias("agent"),
    )


def comparison_timeline(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """One slim row per commit, oldest first."""
    return _slim(ws.comparison_rows(f)).drop("ts").orderBy("timestamp_text", "commit_sha")


def comparison_range(ws: Workspace, f: Filters = NO_FILTER) -> DataFrame:
    """Earliest and latest commit, and the day of the first agent commit."""
    rows = _slim(ws.comparison_rows(f))
    return rows.agg(
        F.min("timestamp_text").alias("earliest"), F.max("timestamp_text").alias("latest"),
        F.substring(F.min(F.when(F.col("agent"), F.col("timestamp_text"))), 1, 10).alias("first_agent_commit_date"))


def _sides(rows: DataFrame, cutoff: str, by_day: bool) -> tuple[Column, Column]:
    stamp = F.col("day") if by_day else F.col("timestamp_text")
    return stamp < cutoff, stamp >= cutoff


def comparison_repos(ws: Workspace, cutoff: str) -> DataFrame:
    """project, in_pre, in_post, in_both."""
    rows = _slim(ws.comparison_rows(NO_FILTER)).where(F.col("project") != "")
    pre, post = _sides(rows, cutoff, by_day=False)
    return (
        rows.groupBy("project").agg(F.bool_or(pre).alias("in_pre"), F.bool_or(post).alias("in_post"))
        .withColumn("in_both", F.col("in_pre") & F.col("in_post"))
    )


COMPARISON_BUCKETS = ["pre", "post", "post_human", "post_agent"]


def comparison(ws: Workspace, cutoff: str, same_repos_only: bool = False, f: Filters = NO_FILTER,
               by_day: bool = False, empty: str = "zero") -> DataFrame:
    """Commit metrics before and after ``cutoff``, one row per bucket.

    ``by_day`` compares calendar days in place of full timestamps; ``empty`` says
    whether an empty bucket shows 'zero' or 'null' metrics.
    """
    rows = _slim(ws.comparison_rows(f))
    pre, post = _sides(rows, cutoff, by_day)
    if same_repos_only:
        both = comparison_repos(ws, cutoff).where("in_both").select("project").withColumn("_both", F.lit(True))
        rows = rows.join(both, "project", "left")
        post = post & F.coalesce("_both", F.lit(False))
    agent = F.col("agent")
    labelled = rows.select("day", "loc_delta", "n_files", "has_test", F.explode(F.array_compact(F.array(
        F.when(pre, "pre"), F.when(post, "post"),
        F.when(post & ~agent, "post_human"), F.when(post & agent, "post_agent")))).alias("bucket"))
    # A histogram of (day, lines, files, test) per bucket carries every metric.
    hist = labelled.groupBy("bucket", "day", "loc_delta", "n_files", "has_test").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")

    def pct(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)) / n * 100

    metrics = hist.groupBy("bucket").agg(
        n.alias("commits"), F.countDistinct("day").alias("active_days"),
        (F.sum(F.col("loc_delta") * F.col("n")) / n).alias("mean_loc_delta"),
        (F.sum(F.col("n_files") * F.col("n")) / n).alias("mean_files"),
        pct(F.col("has_test")).alias("test_commit_pct"),
        pct(F.col("loc_delta") > V.BIG_COMMIT_LOC).alias("big_commit_pct"),
        pct(F.col("loc_delta") < V.SMALL_COMMIT_LOC).alias("small_commit_pct"),
    )
    loc = group_median(hist, ["bucket"], "loc_delta", "n", F.floor(F.col("loc_delta") / 1024))
    files = group_median(hist, ["bucket"], "n_files", "n", F.floor(F.col("n_files") / 1024))
    spark = rows.sparkSession
    labels = spark.range(len(COMPARISON_BUCKETS)).select(
        F.element_at(F.array(*[F.lit(b) for b in COMPARISON_BUCKETS]), (F.col("id") + 1).cast("int")).alias("bucket"))
    joined = (
        labels.join(metrics, "bucket", "left")
        .join(loc.select("bucket", F.col("median").alias("median_loc_delta")), "bucket", "left")
        .join(files.select("bucket", F.col("median").alias("median_files")), "bucket", "left")
    )
    blank = F.lit(0.0) if empty == "zero" else F.lit(None).cast("double")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "bucket", F.coalesce("commits", zero).alias("commits"), F.coalesce("active_days", zero).alias("active_days"),
        F.coalesce(F.col("commits") / F.greatest(F.col("active_days"), F.lit(1)), blank).alias("commits_per_active_day"),
        *[F.coalesce(c, blank).alias(c) for c in (
            "median_loc_delta", "mean_loc_delta", "median_files", "mean_files",
            "test_commit_pct", "big_commit_pct", "small_commit_pct")],
    )


def commit_density(ws: Workspace, f: Filters = NO_FILTER, max_bins: int = 120) -> DataFrame:
    """Commits per bin over the whole range, agent and human apart, zero-filled."""
    rows = _slim(ws.comparison_rows(f))
    # The range is by instant, the position of a commit by its author's calendar day.
    span = rows.agg(
        F.date_diff(F.to_date(F.min_by("ts", "timestamp_text")), F.lit("1970-01-01").cast("date")).alias("base"),
        F.date_diff(F.to_date(F.max_by("ts", "timestamp_text")), F.lit("1970-01-01").cast("date")).alias("last"),
    ).select("base", F.greatest(F.lit(1), F.col("last") - F.col("base")).alias("days"))
    span = span.select(F.struct("base", "days", F.least(F.lit(max_bins), F.col("days") + 1).alias("bins")).alias("span"))
    day_no = F.date_diff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date"))
    # The bounds are one row: a scalar subquery, not a join.
    placed = (
        rows.groupBy("day", "agent").agg(F.count(F.lit(1)).alias("n")).withColumn("span", span.scalar())
        .withColumn("bin", F.least(F.col("span.bins") - 1, F.greatest(F.lit(0), F.floor(
            (day_no - F.col("span.base")) / F.col("span.days") * (F.col("span.bins") - 1)))).cast("int"))
        .groupBy("bin").agg(
            F.sum(F.when(F.col("agent"), F.col("n")).otherwise(0)).alias("agent"),
            F.sum(F.when(~F.col("agent"), F.col("n")).otherwise(0)).alias("human"))
    )
    frame = span.where(F.col("span.base").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.col("span.bins") - 1)).alias("bin"))
    zero = F.lit(0).cast("bigint")
    return (
        frame.join(placed, "bin", "left")
        .select("bin", F.coalesce("agent", zero).alias("agent_commits"), F.coalesce("human", zero).alias("human_commits"))
        .orderBy("bin")
    )
