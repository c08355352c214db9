"""Normalised lake files: traces, git events, daily usage sidecars, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor import schema as S
from spoor.functions import clock, json as J

# Column -> key in the file.
_CAMEL = {
    "session_id": "sessionId", "entry_type": "entryType", "tool_name": "toolName", "tool_call_id": "toolCallId",
    "file_path": "filePath", "task_summary": "taskSummary", "git_repo": "gitRepo", "git_branch": "gitBranch",
    "git_commit": "gitCommit", "user_prompt": "userPrompt", "assistant_text": "assistantText",
    "system_prompt": "systemPrompt", "tool_result_content": "toolResultContent", "file_content": "fileContent",
    "query_data": "queryData", "exit_code": "exitCode", "duration_ms": "durationMs", "timestamp_text": "timestamp",
    "event_type": "eventType", "commit_sha": "commitSha", "parent_shas": "parentShas",
    "files_changed": "filesChanged", "agent_authored": "agentAuthored", "agent_name": "agentName",
    "author_email": "authorEmail", "co_authors": "coAuthors", "pr_number": "prNumber", "pr_title": "prTitle",
    "pr_state": "prState", "pr_url": "prUrl", "pr_base_branch": "prBaseBranch", "pr_head_branch": "prHeadBranch",
    "message_body": "messageBody", "repo_local": "repoLocal", "cache_read": "cacheRead", "cache_creation": "cacheCreation",
}


def _typed(lines: DataFrame, schema) -> DataFrame:
    v = F.col("v")
    getters = {"string": J.text, "bigint": J.integer, "boolean": J.boolean, "array<string>": J.strings}
    cols = []
    for f in schema.fields:
        if f.name in ("ts", "usage"):
            continue
        cols.append(getters[f.dataType.simpleString()](v, "$." + _CAMEL.get(f.name, f.name)).alias(f.name))
    if "usage" in schema.fieldNames():
        cols.append(F.when(J.present(v, "$.tokenUsage"), F.struct(*[
            J.integer(v, "$.tokenUsage." + _CAMEL.get(u.name, u.name)).alias(u.name) for u in S.USAGE.fields
        ])).alias("usage"))
    keep = [c for c in lines.columns if c not in ("line", "v")]
    objects = lines.where(J.is_object_text(F.col("line")))
    rows = objects.withColumn("v", J.parse(F.col("line"))).where(v.isNotNull()).select(*keep, *cols)
    return S.conform(rows.withColumn("ts", clock.parse_ts(F.col("timestamp_text"))), schema)


def parse_traces(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``line``) to traces; lines that are not JSON drop out."""
    return _typed(lines, S.TRACES)


def parse_git(lines: DataFrame) -> DataFrame:
    return _typed(lines, S.GIT_EVENTS)


def malformed(lines: DataFrame) -> DataFrame:
    """How many lines a parse leaves out."""
    return lines.where(F.col("line") != "").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~J.is_object_text(F.col("line")) | J.parse(F.col("line")).isNull()).alias("skipped"))


def read_traces(spark: SparkSession, root: str, file_date: bool = False) -> DataFrame:
    """``{date}/{agent}/*.jsonl`` under root, known agents only. ``file_date`` adds
    ``event_date``, the date each row's file was last modified, for rows without a time."""
    lines = spark.read.text(f"{root}/*/{{{','.join(V.AGENTS)}}}/*.jsonl")
    date = [F.to_date("_metadata.file_modification_time").alias("event_date")] if file_date else []
    return parse_traces(lines.select(F.col("value").alias("line"), *date))


def read_git(spark: SparkSession, root: str) -> DataFrame:
    return parse_git(spark.read.text(f"{root}/*/git/*.jsonl").withColumnRenamed("value", "line"))


def parse_usage(documents: DataFrame) -> DataFrame:
    """Daily usage documents (column ``doc``) to one synthetic row per day at
    23:59 UTC, without a session."""
    v = F.col("v")
    day = J.loose_text(v, "$.date")
    zero = F.lit(0).cast("bigint")
    rows = documents.withColumn("v", J.parse(F.col("doc"))).where(day.isNotNull() & J.present(v, "$.totals"))
    stamp = F.concat(day, F.lit("T23:59:00.000Z"))
    return S.conform(rows.select(
        F.concat(F.lit("cursor-usage-"), day).alias("id"), stamp.alias("timestamp_text"),
        clock.parse_ts(stamp).alias("ts"), F.lit("cursor").alias("agent"), F.lit("usage_summary").alias("entry_type"),
        F.struct(*[
            F.coalesce(J.integer(v, "$.totals." + _CAMEL.get(u.name, u.name)), zero).alias(u.name)
            for u in S.USAGE.fields]).alias("usage"),
    ), S.TRACES)


def stage_usage(spark: SparkSession, root: str, staged: str) -> int:
    """Copy ``{date}/cursor/_usage.json`` documents to visible names: Spark passes
    over files that begin with an underscore. One small file per day; only their
    paths are listed here. Returns how many there are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/*/cursor/_usage.json")
    fs = pattern.getFileSystem(conf)
    found = fs.globStatus(pattern) or []
    for status in found:
        src = status.getPath()
        dst = jvm.org.apache.hadoop.fs.Path(f"{staged}/usage-{src.getParent().getParent().getName()}.json")
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, dst.getFileSystem(conf), dst, False, True, conf)
    return len(found)


def read_usage(spark: SparkSession, staged: str) -> DataFrame:
    return parse_usage(spark.read.text(f"{staged}/usage-*.json", wholetext=True).withColumnRenamed("value", "doc"))


def parse_settings(files: DataFrame) -> DataFrame:
    """Settings documents (label, path, doc) to label, path, pos, entry, error.

    A document is an array of entries or holds them under permissions.allow; only
    non-empty strings count. A broken document gives one row with an error.
    """
    v = F.col("v")
    listed = F.coalesce(J.elements(v), J.elements(v, "$.permissions.allow"))
    entries = F.filter(F.transform(listed, lambda item: J.text(item)), lambda s: s != "")
    return (
        files.withColumn("v", J.parse(F.col("doc")))
        .select("label", "path", F.posexplode_outer(entries).alias("pos", "entry"),
                F.when(F.col("v").isNull(), F.lit("invalid JSON")).alias("error"))
    )


def read_settings(spark: SparkSession, label: str, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True)
    return parse_settings(docs.select(
        F.lit(label).alias("label"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")))
