"""Derived tables and links kept up to date by the partitions that changed."""

import datetime as dt

import pytest
from helpers import git, rows, traces
from pyspark.sql import functions as F

from spoor.operators import attribution
from spoor.plans import derived, lake


def entry(i, agent, session, ts, **more):
    return {"id": i, "agent": agent, "session_id": session, "project": "p", "ts": ts, "tool_name": "Bash", "stdout": "[REDACTED:jwt_token]"} | more


FIRST = [entry("a", "codex", "s5", "2026-01-05T10:00:00Z"), entry("b", "codex", "s5", "2026-01-05T10:30:00Z"),
         entry("c", "claude_code", "s7", "2026-01-20T10:00:00Z", stdout=None)]
COMMITS = [
    {"commit_sha": "in", "ts": "2026-01-05T10:10:00Z", "agent_name": "codex"},                       # s5's window; s2's later, whose id is smaller
    {"commit_sha": "near", "ts": "2026-01-06T12:20:00Z", "agent_name": "cursor", "project": "q"},    # no session until s9 comes
    {"commit_sha": "tie", "ts": "2026-01-05T11:30:00Z", "agent_name": "codex", "project": "q"},      # s5 an hour before, then another as near
    {"commit_sha": "unnamed", "ts": "2026-01-06T12:01:00Z", "agent_name": None},
    {"commit_sha": "human", "ts": "2026-01-06T12:01:00Z", "agent_authored": False, "agent_name": None},
    {"commit_sha": "own", "ts": "2026-01-06T12:02:00Z", "session_id": "given"},
    {"commit_sha": "far", "ts": "2026-03-01T12:00:00Z"}]
LATE = [entry("d", "codex", "s2", "2026-01-05T10:12:00Z"), entry("e", "cursor", "s9", "2026-01-06T12:00:00Z"),
        entry("f", "codex", "s6", "2026-01-05T12:30:00Z", project="other"), entry("g", "codex", "s5", "2026-01-05T09:00:00Z")]


def built(spark, out, some, commits=COMMITS):
    lake.write_traces(lake.with_event_date(traces(spark, some)), f"{out}/traces")
    stamped = git(spark, commits)
    linked = attribution.link_commits(stamped, lake.read_traces(spark, f"{out}/traces"), mark="linked_by")
    lake.write_git(linked, f"{out}/git_events")
    derived.build(spark, out)


def state(spark, out):
    tables = {n: sorted(map(str, derived.read(spark, out, n).collect())) for n in derived.SCHEMAS if n != "session_sketches"}
    tables["sessions"] = sorted(map(str, derived.sessions_estimate(spark, out).collect()))
    links = lake.read_git(spark, f"{out}/git_events", linked=True)
    return tables | {"totals": sorted(map(str, derived.totals(spark, out).collect())),
                     "git": sorted(map(str, rows(links, "commit_sha", "session_id", "agent_name", "linked_by", "agent_authored")))}


def test_refresh_equals_a_full_build(spark, tmp_path):
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    built(spark, out, FIRST)
    before = dict(rows(lake.read_git(spark, f"{out}/git_events"), "commit_sha", "session_id"))
    assert before == {"in": "s5", "near": None, "tie": "s5", "unnamed": None, "human": None, "own": "given", "far": None}
    late = lake.with_event_date(traces(spark, LATE))
    lake.append_new(late, f"{out}/traces")
    touched = derived.touched_by(late)
    for _ in range(2):  # a refresh that runs again changes nothing
        derived.refresh(spark, out, touched, "one")
        built(spark, whole + "x", FIRST + LATE) if not lake.exists(spark, whole + "x") else None
        assert state(spark, out) == state(spark, whole + "x")
    after = dict(rows(lake.read_git(spark, f"{out}/git_events"), "commit_sha", "session_id"))
    assert after == {"in": "s2", "near": "s9", "tie": None, "unnamed": "s9", "human": None, "own": "given", "far": None}


def test_refresh_after_rows_went(spark, tmp_path):
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    built(spark, out, FIRST + LATE)
    gone = [(dt.date(2026, 1, 6), "cursor")]
    lake.delete(spark, f"{out}/traces/{lake.partition_path(event_date='2026-01-06', agent='cursor')}")
    derived.refresh(spark, out, gone)
    built(spark, whole, [e for e in FIRST + LATE if e["id"] != "e"])
    assert state(spark, out) == state(spark, whole)


def test_refresh_reads_touched_dates_only(spark, tmp_path):
    out = str(tmp_path / "out")
    built(spark, out, FIRST)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    some = lake.read_traces(spark, f"{out}/traces").where(derived.in_parts([(dt.date(2026, 1, 5), "codex"), (None, None)]))
    plan = some._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "event_date" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert sorted(r.id for r in some.collect()) == ["a", "b"]
    # Files of other dates are not read at all: the refresh goes through without them.
    lake.delete(spark, f"{out}/traces/{lake.partition_path(event_date='2026-01-20', agent='claude_code')}")
    (tmp_path / "out/traces/event_date=2026-01-20/agent=claude_code").mkdir(parents=True)
    (tmp_path / "out/traces/event_date=2026-01-20/agent=claude_code/part-broken.parquet").write_text("no parquet")
    late = lake.with_event_date(traces(spark, LATE[:1]))
    lake.write_traces(late, f"{out}/traces")
    derived.refresh(spark, out, derived.touched_by(late))
    assert dict(rows(lake.read_git(spark, f"{out}/git_events"), "commit_sha", "session_id"))["in"] == "s2"


def test_totals_keep_a_version_for_readers(spark, tmp_path):
    out = str(tmp_path / "out")
    built(spark, out, FIRST)
    for i, late in enumerate(LATE):
        part = lake.with_event_date(traces(spark, [late]))
        lake.write_traces(part, f"{out}/traces")
        derived.refresh(spark, out, derived.touched_by(part), f"t{i}")
    assert len(lake.versions(spark, f"{out}/totals")) == 2
    tools = derived.totals(spark, out).where("kind = 'tool'")
    assert sorted(rows(tools, "name", "agent", "n")) == [("Bash", "claude_code", 1), ("Bash", "codex", 5), ("Bash", "cursor", 1)]
