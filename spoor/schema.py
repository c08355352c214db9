"""Table schemas. Input is never inferred: every table is conformed to these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE = T.StructType([
    T.StructField(n, T.LongType())
    for n in ("input", "output", "cache_read", "cache_creation", "reasoning")
])

TRACES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "timestamp_text")]
    + [T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in (
        "agent", "session_id", "developer", "machine", "project",
        "entry_type", "role", "model")]
    + [T.StructField("usage", USAGE)]
    + [T.StructField(n, T.StringType()) for n in (
        "tool_name", "tool_call_id", "file_path", "command", "task_summary",
        "git_repo", "git_branch", "git_commit", "user_prompt", "assistant_text",
        "thinking", "reasoning", "system_prompt",
        "tool_result_content", "file_content", "stdout", "query_data")]
    + [
        T.StructField("exit_code", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("success", T.BooleanType()),
    ]
)

# Wide text kept in the lake but never read by the catalogue, except by the
# marker scan.
WIDE_TEXT = [
    "thinking", "reasoning", "system_prompt",
    "tool_result_content", "file_content", "stdout", "query_data",
]

_STRINGS = T.ArrayType(T.StringType())

GIT_EVENTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "timestamp_text")]
    + [T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in (
        "event_type", "project", "repo", "branch", "developer", "machine", "commit_sha")]
    + [T.StructField("parent_shas", _STRINGS)]
    + [T.StructField(n, T.LongType()) for n in ("files_changed", "insertions", "deletions")]
    + [T.StructField("agent_authored", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("agent_name", "author", "author_email")]
    + [T.StructField("co_authors", _STRINGS), T.StructField("message", T.StringType()),
       T.StructField("files", _STRINGS), T.StructField("session_id", T.StringType()),
       T.StructField("pr_number", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in (
        "pr_title", "pr_state", "pr_url", "pr_base_branch", "pr_head_branch",
        "message_body", "repo_local")]
)

FINDINGS = T.StructType(
    [T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in (
        "agent", "session_id", "project", "pattern_type", "source_id", "field")]
)

BATCH = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "batchId", "developer", "machine", "agent", "project", "sourceFile",
        "shippedAt", "receivedAt")]
    + [T.StructField("entries", _STRINGS)]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: missing columns become NULL, extra columns
    stay out, partition columns of the lake (``event_date``) are kept."""
    have = set(df.columns)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    if "event_date" in have:
        cols.append(F.col("event_date").cast("date").alias("event_date"))
    return df.select(*cols)
