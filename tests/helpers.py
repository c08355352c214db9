"""Small tables typed by hand."""

import datetime as dt

from pyspark.sql import types as T

from spoor import schema as S
from spoor import Workspace

UTC = dt.timezone.utc


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC).replace(tzinfo=None)


def _frame(spark, rows, schema, defaults):
    full = []
    for i, r in enumerate(rows):
        row = {f.name: None for f in schema.fields}
        row.update(defaults(i))
        row.update(r)
        if isinstance(row.get("ts"), str):
            row["timestamp_text"] = row.get("timestamp_text") or row["ts"]
            row["ts"] = dt.datetime.fromisoformat(row["ts"].replace("Z", "+00:00"))
        if isinstance(row.get("usage"), tuple):
            row["usage"] = dict(zip((f.name for f in S.USAGE.fields), tuple(row["usage"]) + (None,) * 5))
        full.append(tuple(row[f.name] for f in schema.fields))
    return spark.createDataFrame(full, T.StructType(schema.fields))


def traces(spark, rows):
    return _frame(spark, rows, S.TRACES, lambda i: {
        "id": f"t{i:04d}", "agent": "claude_code", "session_id": "s1", "project": "p", "entry_type": "tool_call",
        "role": "assistant", "ts": "2026-01-01T00:00:00Z"})


def git(spark, rows):
    return _frame(spark, rows, S.GIT_EVENTS, lambda i: {
        "id": f"g{i}", "event_type": "commit", "project": "p", "repo": "o/r", "commit_sha": f"sha{i}",
        "agent_authored": True, "agent_name": "claude_code", "insertions": 0, "deletions": 0,
        "ts": "2026-01-01T00:00:00Z"})


def workspace(spark, trace_rows, git_rows=(), **kw):
    from spoor.operators.security import extract_findings

    t = traces(spark, list(trace_rows))
    return Workspace(traces=t, git=git(spark, list(git_rows)), findings=extract_findings(t), **kw)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
