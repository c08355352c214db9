"""The load jobs over the test tables: each runs twice, or rewrites, and is read back."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor import schema as S
from spoor import session
from spoor.operators import attribution, runs
from spoor.plans import derived, jobs, lake, samples, views
from spoor.sources import codex, raw
from spoor.streaming import ingest


def _history(spark, sf_dir):
    """The chunks of all history, written once for all captures of them."""
    return runs.staged(samples.git_chunks(spark, sf_dir).drop("k"), "history")


def git_scan_twice(spark, sf_dir):
    """History captured half way through and again at its end."""
    out = session.work_folder(spark, "git_scan") + "/git_events"
    traces = S.conform(views.traces(spark, sf_dir), S.TRACES)
    day = F.substring(F.get(F.split("chunk", re.escape(V.COMMIT_FIELD)), F.lit(4)), 1, 10)
    with runs.passing(spark):
        chunks = _history(spark, sf_dir)
        jobs.scan_git(chunks.where(day < "2024-01-15"), traces, out, "full")
        jobs.scan_git(chunks, traces, out, "full")
    return lake.read_git(spark, out).select("commit_sha", "agent_authored", "agent_name", "session_id")


def git_scan_developers(spark, sf_dir):
    """History captured for one developer, for another one, and for all."""
    out = session.work_folder(spark, "git_scan") + "/git_events"
    traces = S.conform(views.traces(spark, sf_dir), S.TRACES)
    with runs.passing(spark):
        chunks = _history(spark, sf_dir)
        for developer in ("dev1", "dev3", None):
            jobs.scan_git(chunks, traces, out, "full", developer)
    return lake.read_git(spark, out).select("commit_sha", "agent_authored", "agent_name", "session_id")


def _captures(spark, sf_dir):
    """Chunks of history, the day of each, and whether its branch was fetched late."""
    fields = F.split("chunk", re.escape(V.COMMIT_FIELD))
    rows = _history(spark, sf_dir).withColumn("_day", F.substring(F.get(fields, F.lit(4)), 1, 10))
    late = F.crc32(F.get(fields, F.lit(0)).cast("binary")) % 5 == 0
    some = rows.where((F.col("_day") < "2024-01-18") & (F.dayofmonth(F.to_date("_day")) % 4 == 1))
    return [some.drop("_day"), rows.where((F.col("_day") < "2024-01-24") & ~late).drop("_day"), rows.drop("_day")]


def git_late_branch(spark, sf_dir):
    """Captures of some days, of most branches up to a day, and of all: commits of days long
    covered arrive last."""
    out = session.work_folder(spark, "git_scan") + "/git_events"
    traces = S.conform(views.traces(spark, sf_dir), S.TRACES)
    with runs.passing(spark):
        for part in _captures(spark, sf_dir):
            jobs.scan_git(part, traces, out, "full")
    return lake.read_git(spark, out).select("commit_sha", "agent_authored", "agent_name", "session_id")


def git_gaps(spark, sf_dir):
    """Days of each repository that two captures of some days left out."""
    out = session.work_folder(spark, "git_scan") + "/git_events"
    traces = S.conform(views.traces(spark, sf_dir).limit(0), S.TRACES)
    repo = F.substring("repo", 7, 9).cast("int")
    with runs.passing(spark):
        some = _captures(spark, sf_dir)[0]
        for part in (some.where(repo % 3 > 0), some.where(repo % 3 < 2)):
            jobs.scan_git(part, traces, out, "basic")
    return jobs.git_gaps(spark, out, "2024-01-03", "2024-01-31")


def export_twice(spark, sf_dir):
    """Half of the composers exported first, then all of them."""
    out = session.work_folder(spark, "export") + "/traces"
    kv = samples.cursor_kv(spark, sf_dir)
    composer = F.get(F.split("key", ":"), F.lit(1))
    for part in (kv.where(F.crc32(composer.cast("binary")) % 2 == 0), kv):
        jobs.load_export(part, out, "full", project="global", home=samples.HOME)
    return lake.read_traces(spark, out).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


def codex_batches(spark, sf_dir):
    """Logs shipped in pieces without a time or all at one time, in two deliveries that
    overlap: models are carried over runs, and some pieces come twice."""
    base = session.work_folder(spark, "codex_batches")
    batches = _codex_pieces(spark, sf_dir)
    for part in (batches.where(F.col("batchId") < "000000010"), batches.where(F.col("batchId") >= "000000008")):
        lake.repartition_by_event(part, f"{base}/traces", "full", models=f"{base}/models")
    return _codex_rows(lake.read_traces(spark, f"{base}/traces"), "session_id")


def _codex_pieces(spark, sf_dir):
    lines = samples.codex_lines(spark, sf_dir)
    one = lines.groupBy("session_key", "chunk", "developer", "machine", "project").agg(
        F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("of"))
    return S.conform(one.select(
        F.lpad(F.col("chunk").cast("string"), 9, "0").alias("batchId"), "developer", "machine", "project", F.lit("codex").alias("agent"),
        F.concat(F.lit("/logs/"), "session_key", F.lit(".jsonl")).alias("sourceFile"),
        F.when(F.crc32(F.col("session_key").cast("binary")) % 2 == 0, "2024-03-01T00:00:00Z").alias("shippedAt"),
        F.col("of.line").alias("entries")), S.BATCH)


def _codex_rows(traces, *first):
    return traces.select(
        *first, "ts", "entry_type", "role", "model", "usage.input", "usage.cache_read", "usage.reasoning",
        "tool_name", "tool_call_id", "command", "user_prompt", "exit_code", "duration_ms", "success").distinct()


def codex_stream(spark, sf_dir):
    """Pieces of logs landed and normalised by streams, in three deliveries: one holds pieces
    of the one before again, and the last brings pieces that should have come first."""
    base = session.work_folder(spark, "codex_stream")
    pieces = _codex_pieces(spark, sf_dir).withColumn("n", F.col("batchId").cast("int"))
    pieces = pieces.withColumn("batchId", F.concat("batchId", F.lit("-"), F.element_at(F.split("sourceFile", "/"), -1)))
    late = F.col("n").isin(0, 3, 4)
    for part in (pieces.where((F.col("n") < 10) & ~late), pieces.where(F.col("n") >= 8), pieces.where(late)):
        sent = part.drop("n")
        sent.select(F.to_json(F.struct(*sent.columns)).alias("value")).write.mode("append").text(f"{base}/inbox")
        lines = ingest.read_lines(spark, f"{base}/inbox")
        ingest.land(ingest.parse_batches(lines), None, f"{base}/raw", f"{base}/landing", available_now=True).awaitTermination()
        ingest.stream_logs(spark, f"{base}/raw", base, f"{base}/state", "full", available_now=True).awaitTermination()
    return _codex_rows(lake.read_traces(spark, f"{base}/traces"), "session_id")


def codex_projects(spark, sf_dir):
    """Log files, each named by Spark, loaded twice; the project comes from their headers,
    which one log in seven lacks."""
    base = session.work_folder(spark, "codex_projects")
    lines = samples.codex_lines(spark, sf_dir).select("session_key", F.col("seq").cast("bigint"), "line")
    user = F.substring("session_key", 2, 20).cast("bigint")
    header = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("/home/u/dev/p"), (user % 5).cast("string")).alias("cwd")).alias("payload")))
    heads = lines.select("session_key").distinct().where(user % 7 != 0).select("session_key", F.lit(-1).cast("bigint"), header)
    files = lines.union(heads).repartition("session_key").sortWithinPartitions("session_key", "seq")
    files.select("session_key", F.col("line").alias("value")).write.partitionBy("session_key").text(f"{base}/logs")
    for _ in range(2):
        jobs.load_logs(spark, f"{base}/logs", "codex", f"{base}/traces", "full")
    return _codex_rows(lake.read_traces(spark, f"{base}/traces"), "project")


def undated_batches(spark, sf_dir):
    """Entries without a time are filed under the day their batch came."""
    out = session.work_folder(spark, "undated") + "/traces"
    batches = _undated(spark, sf_dir, 0)
    for _ in range(2):
        lake.repartition_by_event(batches, out, "full")
    return lake.read_traces(spark, out).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def undated_twice(spark, sf_dir):
    """Entries without a time that come again on later days stay where they were filed."""
    out = session.work_folder(spark, "undated") + "/traces"
    for days in (0, 3, 40):
        lake.repartition_by_event(_undated(spark, sf_dir, days), out, "full")
    return lake.read_traces(spark, out).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def _undated(spark, sf_dir, days):
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    line = F.to_json(F.struct(F.lit("user").alias("type"), "turn", F.struct(F.array(block).alias("content")).alias("message")))
    name = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    return S.conform(views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(line).alias("entries")).select(
        name.alias("batchId"), F.lit("d").alias("developer"), F.lit("claude_code").alias("agent"), F.concat(name, F.lit(".jsonl")).alias("sourceFile"),
        F.date_format(F.date_add(F.lit("2024-02-01").cast("date"), (F.col("conv_id") % 20 + days).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("receivedAt"),
        "entries"), S.BATCH)


def erase_developer(spark, sf_dir):
    """All three tables after one of five developers was erased."""
    base = session.work_folder(spark, "erase")
    lake.write_traces(lake.with_event_date(S.conform(views.traces(spark, sf_dir), S.TRACES)), f"{base}/old/traces")
    git = S.conform(views.commits(spark, sf_dir), S.GIT_EVENTS)
    lake.write_git(git.withColumn("developer", F.replace(F.lower("author"), F.lit(" "), F.lit(""))), f"{base}/old/git_events")
    lake.write_findings(spark, f"{base}/old")
    lake.erase_developer(spark, f"{base}/old", f"{base}/new", "dev3")
    ws = lake.workspace(spark, f"{base}/new")

    def counted(table, name, column):
        return table.groupBy(F.lit(name).alias("tab"), F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))

    return counted(ws.traces, "traces", "developer").union(counted(ws.git, "git_events", "author")).union(
        counted(ws.findings, "findings", "pattern_type"))


def _deliveries(spark, sf_dir):
    """The traces in three deliveries: most of the first weeks, then the sessions of these
    weeks that came late, then the rest."""
    rows = lake.with_event_date(S.conform(views.traces(spark, sf_dir), S.TRACES))
    early, late = F.col("ts") < "2024-01-20", F.crc32(F.coalesce("session_id", "id").cast("binary")) % 3 == 0
    return [rows.where(early & ~late), rows.where(early & late), rows.where(~early)]


def _fed(spark, sf_dir, name):
    """A lake built from the first delivery, which a stream keeps fresh as the others come;
    the second one's rows come twice."""
    out = session.work_folder(spark, name)
    first, second, third = _deliveries(spark, sf_dir)
    lake.write_traces(first, f"{out}/traces")
    git = S.conform(views.commits(spark, sf_dir, linked=False), S.GIT_EVENTS)
    lake.write_git(attribution.link_commits(git, lake.read_traces(spark, f"{out}/traces"), mark="linked_by"), f"{out}/git_events")
    derived.build(spark, out)
    for rows in (None, second, second, third):
        if rows is not None:
            lake.append_new(rows, f"{out}/traces")
        ingest.keep_fresh(spark, out, f"{out}/state", available_now=True).awaitTermination()
    return out


def refresh_twice(spark, sf_dir):
    """Derived tables after three deliveries, only touched partitions recomputed."""
    out = _fed(spark, sf_dir, "refresh")
    n = F.count(F.lit(1)).alias("n")
    found = lake.read_findings(spark, f"{out}/findings").groupBy(F.lit("findings").alias("tab"), F.col("pattern_type").alias("name"), "agent").agg(n)
    totals = derived.totals(spark, out).select("kind", "name", "agent", "n")
    patterns = derived.read(spark, out, "session_patterns").select("session_id", "pattern_type", "agent").distinct().groupBy(
        F.lit("session_patterns"), "pattern_type", "agent").agg(n)
    windows = derived.windows(derived.read(spark, out, "session_days"))
    spans = windows.groupBy(F.lit("windows"), "project", "agent").agg(F.sum(F.col("end_ms") - F.col("start_ms")))
    return found.union(totals).union(patterns).union(spans)


def relink_late_traces(spark, sf_dir):
    """Commits linked when some of their sessions had not arrived, and anew as these did."""
    out = _fed(spark, sf_dir, "relink")
    return lake.read_git(spark, f"{out}/git_events").select("commit_sha", "agent_name", "session_id")


def cut_batches(spark, sf_dir):
    """Documents as the lines of one log per source, cut into batches; some are larger than
    a batch may be, and one source has most of them."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    lines = views.table(spark, sf_dir, "documents").select(
        "source", *[F.lit("d").alias(c) for c in ("developer", "machine", "project")], F.lit(0).alias("chunk"), F.col("doc_id").alias("seq"),
        F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit(',"t":"'), text, F.lit('"}')).alias("line"))
    out = raw.to_batches(lines, "claude_code", max_entries=50, max_bytes=16_384, block=64)
    size = F.aggregate("entries", F.lit(0).cast("bigint"), lambda acc, x: acc + F.octet_length(x))
    first = F.get_json_object(F.get("entries", F.lit(0)), "$.id").cast("bigint")
    return out.select(F.col("sourceFile").alias("source"), first.alias("first_id"), F.size("entries").cast("bigint").alias("entries"), size.alias("bytes"),
                      F.md5(F.array_join("entries", "\n")).alias("digest"), "batchId")


def session_estimates(spark, sf_dir):
    """Sessions of each project, counted and estimated from stored sketches, of which some days
    were refreshed: whether they agree within four standard errors."""
    out = session.work_folder(spark, "sketches")
    first, second, third = _deliveries(spark, sf_dir)
    lake.write_traces(first.union(second), f"{out}/traces")
    derived.build(spark, out)
    lake.write_traces(third, f"{out}/traces")
    derived.refresh(spark, out, derived.touched_by(third))
    exact = views.traces(spark, sf_dir).groupBy("project").agg(F.countDistinct("session_id").alias("exact"))
    about = derived.sessions_estimate(spark, out)
    near = F.abs(F.col("sessions") - F.col("exact")) <= 4 * 1.04 / 64 * F.col("exact") + 1
    return exact.join(about.withColumnRenamed("project", "p"), F.col("project").eqNullSafe(F.col("p"))).select("project", "exact", near.alias("near"))


def erase_everywhere(spark, sf_dir):
    """Every zone of a lake after one developer was erased in place; only files that held
    the developer were written again."""
    base = session.work_folder(spark, "erase")
    lake.write_traces(lake.with_event_date(S.conform(views.traces(spark, sf_dir), S.TRACES)), f"{base}/traces")
    git = S.conform(views.commits(spark, sf_dir), S.GIT_EVENTS)
    lake.write_git(git.withColumn("developer", F.replace(F.lower("author"), F.lit(" "), F.lit(""))), f"{base}/git_events")
    derived.build(spark, base)
    sent = samples.batches(spark, sf_dir)
    lake.land_batches(S.conform(sent, S.BATCH), f"{base}/raw")
    S.conform(sent.where("day < 5"), S.BATCH).write.parquet(f"{base}/rejects/epoch=0")
    user = F.substring("session_key", 2, 20).cast("bigint")
    codex.model_state(samples.codex_lines(spark, sf_dir).withColumn("developer", F.concat(F.lit("dev"), (user % 7).cast("string")))).write.parquet(f"{base}/models")
    lake.erase(spark, base, "dev3", f"{base}/raw", f"{base}/rejects")

    def counted(table, name, column):
        return table.groupBy(F.lit(name).alias("tab"), F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))

    return functools.reduce(DataFrame.union, [counted(*x) for x in (
        (lake.read_traces(spark, f"{base}/traces"), "traces", "developer"), (lake.read_git(spark, f"{base}/git_events"), "git_events", "author"),
        (lake.read_findings(spark, f"{base}/findings"), "findings", "pattern_type"), (lake.read_batches(spark, f"{base}/raw"), "raw", "developer"),
        (spark.read.parquet(f"{base}/rejects"), "rejects", "developer"), (spark.read.parquet(f"{base}/models"), "models", "_developer"))])


QUERIES = {f.__name__: f for f in (git_scan_twice, git_scan_developers, export_twice, codex_batches, undated_batches, erase_developer,
                                   refresh_twice, relink_late_traces, cut_batches, codex_stream, codex_projects, undated_twice, git_late_branch, git_gaps, erase_everywhere, session_estimates)}
