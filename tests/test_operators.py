"""Query cases on hand-made tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import git, rows, traces, workspace
from spoor import Filters, Workspace
from spoor.operators import attribution as A
from spoor.operators import commits as C
from spoor.operators import detectors as D
from spoor.operators import intervals as I
from spoor.operators import overview as O
from spoor.operators import permissions as P
from spoor.operators import rollups as U
from spoor.operators import security as X
from spoor.operators import sessions as S
from spoor.operators import skills as K
from spoor.operators.skew import group_median, top_n_per_group


def bash(ts, command, sid="s1", call=None, **kw):
    return {"ts": ts, "tool_name": "Bash", "command": command, "session_id": sid, "tool_call_id": call, **kw}


def test_filters_reject_bad_values():
    for bad in ({"days": 0}, {"days": "7"}, {"days": True}, {"granularity": "year"}, {"date": "2026-1-1"}):
        with pytest.raises(ValueError):
            Filters(**bad)


def test_stats_and_days_filter(spark):
    ws = workspace(spark, [
        {"ts": "2026-01-01T00:00:00Z", "usage": (100, 50, 10, 5)},
        {"ts": "2026-01-02T00:00:00Z", "usage": (200, 70), "session_id": "s2", "project": "q"},
        {"ts": "2026-01-03T12:00:00Z", "session_id": None, "project": None},
        {"ts": None, "usage": (9, 9)},
    ], today=dt.date(2026, 1, 3))
    assert rows(O.stats(ws), "total_entries", "total_sessions", "total_projects", "total_days",
                "total_input_tokens", "total_output_tokens", "total_cache_read", "total_cache_creation") \
        == [(3, 2, 2, 3, 300, 120, 10, 5)]
    assert O.stats(ws, Filters(days=1)).first()["total_entries"] == 2


def test_week_of_a_monday(spark):
    ws = workspace(spark, [{"ts": "2026-01-05T10:00:00Z"}, {"ts": "2026-01-06T10:00:00Z"}])
    week = Filters(granularity="week")
    assert [str(d) for (d,) in rows(O.activity(ws, week), "date")] == ["2025-12-29", "2026-01-05"]
    iso = Workspace(traces=ws.traces, week_mode="iso")
    assert [str(d) for (d,) in rows(O.activity(iso, week), "date")] == ["2026-01-05"]


def test_tools_primary_agent_and_parity(spark):
    ws = workspace(spark, [
        {"tool_name": "Read"}, {"tool_name": "Read"}, {"tool_name": "Read", "agent": "codex", "project": "q"},
    ])
    assert rows(O.tools(ws), "tool_name", "count", "primary_agent", "agents") == [("Read", 3, "claude_code", ["claude_code", "codex"])]
    only_q = Filters(project="q")
    assert rows(O.tools(ws, only_q), "count", "primary_agent", "agents") == [(1, "claude_code", ["claude_code", "codex"])]
    strict = Workspace(traces=ws.traces, parity=False)
    assert rows(O.tools(strict, only_q), "count", "primary_agent", "agents") == [(1, "codex", ["codex"])]


def test_mcp_sentinel(spark):
    ws = workspace(spark, [{"tool_name": n} for n in ("mcp:db:q", "MCP__db__q", "mcpx", "mcp_db_q", "Read")])
    assert O.stats(ws, Filters(tool="*mcp")).first()["total_entries"] == 2


def test_motifs(spark):
    ws = workspace(spark, [
        *[bash("2026-01-01T00:00:00Z", f"  grep -r foo{i}", sid=f"s{i % 2}", usage=(10, 0)) for i in range(4)],
        {"tool_name": "Edit", "file_path": "/a/b.ts"}, {"tool_name": "Edit", "file_path": "/c.d/e.ts"},
        {"tool_name": "Edit", "file_path": "/x.y/noext"},
    ])
    assert rows(O.motifs(ws), "tool_name", "shape", "occurrences", "sessions", "tokens") == [
        ("Bash", "grep", 4, 2, 40), ("Edit", ".ts", 2, 1, 0)]


def test_stumbles_collapse_paths_and_strings(spark):
    ws = workspace(spark, [
        bash("2026-01-01T00:00:00Z", "grep 'a b' /x/y"), bash("2026-01-01T00:01:00Z", 'grep "c"  /z'),
        bash("2026-01-01T00:02:00Z", "grep 'd' ./q.ts", usage=(5, 5)),
        *[{"tool_name": "Edit", "file_path": "/a"} for _ in range(5)],
        {"entry_type": "message", "role": "user", "usage": (100, 0)},
    ])
    assert rows(D.stumbles(ws), "shape", "occurrences", "tokens", "session_tokens") == [("grep <str> <path>", 3, 10, 110)]


def test_active_time_and_sparkline(spark):
    stamps = ["00:00:00", "00:04:00", "00:09:00", "00:59:58", "01:00:02", "05:00:00"]
    ws = workspace(spark, [{"ts": f"2026-01-01T{s}Z"} for s in stamps])
    # 4 min + 5 min (exactly the limit counts) + 4 s over the hour.
    assert rows(S.active_time(ws), "active_ms") == [((4 + 5) * 60_000 + 4000,)]
    spark_line = rows(S.session_activity(ws).orderBy("bucket"), "bucket", "entries")
    assert len(spark_line) == 60 and spark_line[0][1] == 2 and spark_line[59][1] == 1
    assert sum(n for _, n in spark_line) == 6
    one = workspace(spark, [{}, {}])
    assert rows(S.session_activity(one), "bucket", "entries") == [(0, 2)]
    assert rows(S.active_time(one), "active_ms") == [(0,)]


def test_validation_coverage(spark):
    ws = workspace(spark, [
        {"tool_name": "Edit", "ts": "2026-01-01T00:00:00Z"}, bash("2026-01-01T00:01:00Z", "BUN TEST x"),
        {"tool_name": "edit", "ts": "2026-01-01T00:00:00Z", "session_id": "s2"},
        bash("2026-01-01T00:00:00Z", "pytest -q", sid="s2"),
        {"tool_name": "Read", "session_id": "s3"},
    ])
    assert rows(D.validation_coverage(ws), "session_id", "validated_after_edit") == [("s2", False), ("s1", True)]


def test_validation_loops_use_the_latest_result(spark):
    calls = [bash(f"2026-01-01T00:0{i}:00Z", "pytest -q", call=f"c{i}") for i in range(3)]
    results = [{"entry_type": "tool_result", "role": "tool", "tool_call_id": f"c{i}", "ts": f"2026-01-01T00:0{i}:30Z",
                "success": False} for i in range(3)]
    late = {"entry_type": "tool_result", "role": "tool", "tool_call_id": "c2", "ts": "2026-01-01T00:09:00Z", "success": None}
    ws = workspace(spark, [*calls, *results, late])
    got = D.validation_loops(ws).first()
    assert (got.attempts, got.failures) == (3, 2)
    assert got.ended_at.minute == 9


def test_intervention_and_ratio(spark):
    ws = workspace(spark, [
        {"entry_type": "message", "role": "user"}, {"entry_type": "message", "role": "user"},
        {"tool_name": "Read"}, bash("2026-01-01T00:00:00Z", "git status"), {"tool_name": "Edit"},
        {"session_id": "s2", "tool_name": "Read"},
    ], [{"session_id": "s1", "insertions": 3, "deletions": 1}, {"session_id": "s1", "agent_authored": False}])
    assert rows(D.intervention_rate(ws), "session_id", "user_turns", "tool_calls", "commits", "loc_delta",
                "tools_per_turn", "turns_per_commit", "turns_per_loc") == [("s1", 2, 3, 1, 4, 1.5, 2.0, 0.5)]
    assert rows(D.search_to_edit(ws), "session_id", "reads", "edits", "ratio") == [("s1", 2, 1, 2.0)]


def test_latency_takes_the_last_prompt_within_two_hours(spark):
    def msg(ts, sid):
        return {"entry_type": "message", "role": "user", "ts": ts, "session_id": sid}

    ws = workspace(spark, [
        msg("2026-01-01T00:00:00Z", "s1"), msg("2026-01-01T10:00:00Z", "s1"), msg("2026-01-01T10:31:00Z", "s1"),
        {"tool_name": "Edit", "ts": "2026-01-01T10:30:00Z"},
        msg("2026-01-01T08:00:00Z", "s2"), {"tool_name": "Edit", "ts": "2026-01-01T10:00:00Z", "session_id": "s2"},
        msg("2026-01-01T07:59:59Z", "s3"), {"tool_name": "Edit", "ts": "2026-01-01T10:00:00Z", "session_id": "s3"},
        msg("2026-01-01T09:00:00Z", "s4"),
    ], [{"session_id": "s4", "ts": "2026-01-01T09:05:00Z"}])
    assert sorted(rows(D.first_action_latency(ws), "session_id", "latency_ms")) == [
        ("s1", 30 * 60_000), ("s2", 7_200_000), ("s4", 5 * 60_000)]


def test_productivity_buckets(spark):
    stuck = []
    for i in range(3):
        stuck.append(bash(f"2026-01-01T00:1{i}:00Z", "pytest", sid="stuck", call=f"k{i}"))
        stuck.append({"entry_type": "tool_result", "tool_call_id": f"k{i}", "session_id": "stuck", "success": False,
                      "ts": f"2026-01-01T00:1{i}:30Z"})
    ws = workspace(spark, [
        {"tool_name": "Edit", "session_id": "good"}, bash("2026-01-01T00:05:00Z", "bun test", sid="good"),
        {"tool_name": "Edit", "session_id": "stuck"}, *stuck,
        {"tool_name": "Edit", "session_id": "plain", "usage": (1_000_000, 0)},
        {"tool_name": "Read", "session_id": "reader"},
    ], [{"session_id": "good", "insertions": 200}])
    got = {r.session_id: r for r in D.productivity_score(ws).collect()}
    assert set(got) == {"good", "stuck", "plain"}
    assert (got["good"].bucket, got["good"].score, got["good"].green_flags) == ("productive", 67, ["shipped-commit", "validated"])
    assert got["stuck"].bucket == "stuck" and got["stuck"].red_flags == ["stuck-loops"] and got["stuck"].score == 52
    assert got["plain"].red_flags == ["no-validation", "dark-spend"] and got["plain"].score == 30
    assert [r.session_id for r in D.productivity_score(ws).collect()] == ["good", "stuck", "plain"]
    summary = U.productivity_summary(ws).first()
    assert (summary.total, summary.productive, summary.stuck, summary.needs_better_setup) == (3, 1, 1, 1)


def test_skills(spark):
    def said(text, **kw):
        return {"entry_type": "message", "role": "user", "user_prompt": text, **kw}

    ws = workspace(spark, [
        said("/ship it"), said("  /ship  "), said("/private/tmp/x"), said("/"), said("/ nothing"), said("no"),
        {"tool_name": "skill:ship", "agent": "codex", "session_id": "s2"}, {"tool_name": "skill:"},
    ])
    assert rows(K.skill_usage(ws), "name", "count", "sessions", "agents") == [("ship", 3, 2, ["claude_code", "codex"])]
    assert rows(K.slash_words(ws), "skill", "count")[0] == ("/ship", 2)
    assert rows(K.skill_sessions(ws, "ship").orderBy("session_id"), "session_id", "count") == [("s1", 2), ("s2", 1)]


def test_findings_count_every_marker(spark):
    ws = workspace(spark, [
        {"stdout": "[REDACTED:jwt_token] x [REDACTED:jwt_token]", "file_content": "[REDACTED:openai_key]",
         "ts": "2026-01-01T00:00:00Z"},
        {"query_data": "[REDACTED:jwt_token]", "tool_result_content": "[REDACTED:bad-name]", "ts": "2026-01-02T00:00:00Z",
         "agent": "codex"},
    ])
    assert rows(X.findings_by_pattern(ws), "pattern_type", "count", "agents") == [
        ("jwt_token", 3, ["claude_code", "codex"]), ("openai_key", 1, ["claude_code"])]
    one_day = Filters(date="2026-01-02", days=1)
    assert rows(X.findings_by_pattern(ws, one_day), "pattern_type", "count", "agents") == [("jwt_token", 1, ["claude_code", "codex"])]
    assert ws.findings.where("field = 'stdout'").count() == 2


# ---- attribution ----------------------------------------------------------------

def _call(ts, sid, project="p", agent="claude_code"):
    return {"ts": ts, "session_id": sid, "project": project, "agent": agent, "tool_name": "Bash", "command": "ls"}


def test_link_commits_cases(spark):
    t = traces(spark, [
        _call("2026-01-01T10:00:00Z", "a"), _call("2026-01-01T11:00:00Z", "a"),
        _call("2026-01-01T10:30:00Z", "b"),
        _call("2026-01-02T10:00:00Z", "x1", "other"), _call("2026-01-02T10:20:00Z", "x2", "other"),
        _call("2026-01-03T00:00:00Z", "idle", "other"), _call("2026-01-03T23:00:00Z", "idle", "other"),
        _call("2026-01-03T12:00:00Z", "busy", "else"),
        _call("2026-01-04T10:00:00Z", "cx", "other", "codex"),
    ])
    g = git(spark, [
        {"commit_sha": "in-two", "ts": "2026-01-01T10:32:00Z"},
        {"commit_sha": "edge", "ts": "2026-01-01T11:05:00Z"},
        {"commit_sha": "human", "ts": "2026-01-01T10:31:00Z", "agent_authored": False, "agent_name": None},
        {"commit_sha": "tie", "ts": "2026-01-02T10:10:00Z", "project": "none"},
        {"commit_sha": "near", "ts": "2026-01-02T10:11:00Z", "project": "none"},
        {"commit_sha": "busy", "ts": "2026-01-03T12:35:00Z", "project": "none"},
        {"commit_sha": "other-agent", "ts": "2026-01-04T10:01:00Z", "project": "none"},
        {"commit_sha": "far", "ts": "2026-01-05T10:00:00Z", "project": "none"},
        {"commit_sha": "named", "ts": "2026-01-01T10:00:00Z", "agent_name": None},
        {"commit_sha": "kept", "ts": "2026-01-01T10:00:00Z", "session_id": "z"},
    ])
    got = {r.commit_sha: (r.session_id, r.agent_name, r.agent_authored) for r in A.link_commits(g, t).collect()}
    assert got["in-two"][0] == "a" and got["edge"][0] == "a"
    assert got["human"] == (None, None, False)
    assert got["tie"][0] is None and got["near"][0] == "x2" and got["busy"][0] == "busy"
    assert got["other-agent"][0] is None and got["far"][0] is None
    assert got["named"] == ("a", "claude_code", True) and got["kept"][0] == "z"
    scan = {r.commit_sha: (r.session_id, r.agent_authored) for r in A.attribute_at_scan(g, t).collect()}
    assert scan["human"] == ("a", True)


def test_first_covering_against_brute_force(spark):
    rng = random.Random(7)
    ivs = [(rng.choice("kl"), lo, lo + rng.choice([0, 5, 900, 10_000_000]), f"s{i:03d}")
           for i, lo in enumerate(rng.randrange(-50, 3_000_000) for _ in range(120))]
    pts = [(rng.choice("klm"), rng.randrange(-100, 12_000_000)) for _ in range(300)] + [(k, lo) for k, lo, _, _ in ivs] \
        + [(k, hi) for k, _, hi, _ in ivs] + [(k, hi + 1) for k, _, hi, _ in ivs]
    want = {}
    for k, x in pts:
        hit = [s for kk, lo, hi, s in ivs if kk == k and lo <= x <= hi]
        if hit:
            want[(k, x)] = min(hit)
    got = I.first_covering(
        spark.createDataFrame(pts, "k string, at long"), spark.createDataFrame(ivs, "k string, lo long, hi long, best string"),
        "k", "at", "lo", "hi", "best")
    assert {(r.k, r["at"]): r.best for r in got.collect()} == want


def test_nearest_unique_against_brute_force(spark):
    rng = random.Random(11)
    hour = 3_600_000
    marks = [(rng.choice("kl"), rng.randrange(0, 12 * hour) // 60_000 * 60_000, f"s{rng.randrange(9)}") for _ in range(60)]
    pts = [(rng.choice("klm"), rng.randrange(0, 13 * hour) // 30_000 * 30_000) for _ in range(300)] + [
        ("k", m) for _, m, _ in marks]
    want = {}
    for k, x in pts:
        dist = {}
        for kk, m, s in marks:
            if kk == k and abs(m - x) <= hour:
                dist[s] = min(dist.get(s, hour + 1), abs(m - x))
        best = [s for s, d in dist.items() if d == min(dist.values())]
        if len(best) == 1:
            want[(k, x)] = best[0]
    got = I.nearest_unique(
        spark.createDataFrame(pts, "k string, at long"), spark.createDataFrame(marks, "k string, m long, owner string"),
        "k", "at", "m", "owner", hour)
    assert {(r.k, r["at"]): r.owner for r in got.collect()} == want


def test_group_median_against_sorted_lists(spark):
    rng = random.Random(3)
    data = {k: [rng.choice([rng.randrange(5000), 7]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 51), ("d", 200))}
    hist = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v long").groupBy("k", "v").agg(
        F.count(F.lit(1)).alias("n"))
    got = {r.k: (r.median, r.upper) for r in group_median(hist, ["k"], "v", "n", F.floor(F.col("v") / 64)).collect()}
    for k, vs in data.items():
        s = sorted(vs)
        assert got[k] == ((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, s[len(s) // 2])


def test_top_n_keeps_a_hot_group_whole(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("cold", 1)], "k string, v long"))
    got = top_n_per_group(df, ["k"], [F.desc("v")], 3, ["v"])
    assert sorted(rows(got, "k", "v", "rank")) == [("cold", 1, 1), ("hot", 4997, 3), ("hot", 4998, 2), ("hot", 4999, 1)]


# ---- git ----------------------------------------------------------------------------

def test_comparison_buckets(spark):
    ws = workspace(spark, [], [
        {"ts": "2026-01-10T00:00:00Z", "agent_authored": False, "insertions": 10, "files": ["tests/a.py"]},
        {"ts": "2026-01-11T00:00:00Z", "agent_authored": False, "insertions": 600, "files": ["a.py", "b.py"]},
        {"ts": "2026-02-02T00:00:00Z", "insertions": 20, "deletions": 20, "files": ["x.spec.ts"]},
        {"ts": "2026-02-02T05:00:00Z", "agent_authored": False, "project": "new"},
    ])
    got = {r.bucket: r for r in C.comparison(ws, "2026-02-01").collect()}
    assert (got["pre"].commits, got["pre"].median_loc_delta, got["pre"].test_commit_pct, got["pre"].big_commit_pct) == (2, 305.0, 50.0, 50.0)
    assert (got["post"].commits, got["post"].active_days, got["post"].commits_per_active_day) == (2, 1, 2.0)
    assert (got["post_human"].commits, got["post_agent"].median_files) == (1, 1.0)
    same = {r.bucket: r.commits for r in C.comparison(ws, "2026-02-01", same_repos_only=True).collect()}
    assert same == {"pre": 2, "post": 1, "post_human": 0, "post_agent": 1}
    empty = {r.bucket: r for r in C.comparison(ws, "2027-01-01", empty="null").collect()}
    assert empty["post"].commits == 0 and empty["post"].median_loc_delta is None
    assert C.comparison_range(ws).first().first_agent_commit_date == "2026-02-02"


def test_git_counts_and_gaps(spark):
    ws = workspace(spark, [{"session_id": "s1"}], [
        {"session_id": "s1", "insertions": 5}, {"insertions": 1}, {"agent_authored": False}, {"event_type": "pr_open"},
    ])
    s = C.git_stats(ws).first()
    assert (s.total_commits, s.agent_commits, s.human_commits, s.linked_agent_commits, s.agent_insertions) == (3, 2, 1, 1, 6)
    assert rows(C.attribution_gaps(ws), "project", "coverage_pct") == [("p", 50)]
    assert rows(C.coverage(ws), "agent_pct", "linked_pct") == [(67, 50)]
    assert rows(C.git_sessions(ws), "session_id", "commits", "duration_ms") == [("s1", 1, 0)]
    assert C.commit_density(ws).agg(F.sum("agent_commits"), F.sum("human_commits")).first()[:] == (2, 1)


# ---- permissions -----------------------------------------------------------------------

def test_permission_paths(spark):
    ws = workspace(spark, [
        bash("2026-01-01T00:00:00Z", "LC_ALL=C A=b bun --hot test x"), bash("2026-01-01T00:00:00Z", "git -C status"),
        bash("2026-01-01T00:00:00Z", "PID=$(lsof -ti :3000)"), bash("2026-01-01T00:00:00Z", "ls $(pwd)"),
        bash("2026-01-01T00:00:00Z", "  -x  "), bash("2026-01-01T00:00:00Z", ""),
        {"tool_name": "shell", "command": "weird"}, {"tool_name": "stdin"}, {"tool_name": "mcp__a__b"}, {"tool_name": "Read"},
    ])
    assert sorted(rows(P.permissions(ws), "category", "allow_entry", "depth")) == [
        ("build", "Bash(bun test:*)", 3), ("build", "Bash(bun:*)", 2), ("core", "Bash(git status:*)", 3),
        ("core", "Bash(git:*)", 2), ("core", "Bash(ls:*)", 2), ("file", "Read", 1), ("mcp", "mcp__a__b", 1),
        ("other", "Shell(weird:*)", 2), ("other", "Stdin", 1)]


def _list(spark, *entries):
    return spark.createDataFrame(list(enumerate(entries)), "pos long, entry string")


def test_merge_lists(spark):
    got = P.merge(
        _list(spark, "Bash(bun install foo)", "Bash(git *)", " Read ", "WebFetch(domain:x)", "Bash(open"),
        _list(spark, "Bash(bun:*)", "Bash(git:*)", "Read", "Bash(bun install:*)", "Shell(bun x)"))
    by = {r.entry: (r.kept, r.added, r.subsumed_by) for r in got.collect()}
    assert by["Bash(bun install foo)"] == (False, False, "Bash(bun:*)")
    assert by["Bash(bun install:*)"] == (False, False, "Bash(bun:*)")
    assert by["Bash(git *)"] == (True, False, None) and by["Bash(git:*)"] == (True, True, None)
    assert by["Read"] == (True, False, None) and by["Shell(bun x)"] == (True, True, None)
    assert "Bash(open" not in by


def test_mark_and_broaden(spark):
    perms = spark.createDataFrame([("Bash(git:*)",), ("Bash(git status:*)",), ("Bash(bun:*)",), ("Read",)], "allow_entry string")
    # One entry covering the other, either way round, counts as present.
    marked = P.mark_existing(perms, _list(spark, "Bash(git status foo)", "Read"))
    assert dict(rows(marked, "allow_entry", "existing")) == {
        "Bash(git:*)": True, "Bash(git status:*)": True, "Bash(bun:*)": False, "Read": True}
    wider = P.mark_existing(perms, _list(spark, "Bash(git *)", "Bash(bun install)"))
    assert dict(rows(wider, "allow_entry", "existing")) == {
        "Bash(git:*)": True, "Bash(git status:*)": True, "Bash(bun:*)": True, "Read": False}
    assert rows(P.broadening(_list(spark, "Bash(npm a)", "Bash(npm b *)", "Bash(go a)", "Bash(go b)", "Bash(go:*)")),
                "entry", "count") == [("Bash(npm:*)", 2)]


def test_rules_both_ways(spark):
    rules = spark.createDataFrame(
        [(1, [["git"], ["status", "diff"]], "allow"), (2, [["rm"]], "deny")], "rule_id long, pattern array<array<string>>, decision string")
    assert sorted(rows(P.expand_rules(rules), "entry")) == [("Shell(git diff:*)",), ("Shell(git status:*)",)]
    text = P.format_rules(_list(spark, "Bash(git status:*)", "Shell(git diff:*)", "Bash(ls:*)", "Bash(a (b):*)", "Read", "Bash(npm i:*)"))
    assert [l for (l,) in rows(text, "line")] == [
        'prefix_rule(pattern=["ls"], decision="allow")',
        'prefix_rule(pattern=["git", ["diff", "status"]], decision="allow")',
        'prefix_rule(pattern=["npm", "i"], decision="allow")',
        'prefix_rule(pattern=["a", "(b)"], decision="allow")']


def test_candidates_with_overrides(spark):
    ws = workspace(spark, [bash("2026-01-01T00:00:00Z", "git status"), {"tool_name": "Read"}])
    perms = P.permissions(ws)
    assert rows(P.candidates(perms), "allow_entry") == [("Bash(git:*)",), ("Read",)]
    extra = spark.createDataFrame([("Bash(git:*)", True), ("Read", False)], "allow_entry string, include boolean")
    assert rows(P.candidates(perms, "sub", extra), "allow_entry") == [("Bash(git:*)",)]


# ---- metamorphic ---------------------------------------------------------------------------

def test_results_do_not_depend_on_partitioning(spark):
    ws = workspace(spark, [
        bash(f"2026-01-01T00:{i % 60:02d}:00Z", f"grep x{i % 3}", sid=f"s{i % 4}", usage=(i, 1)) for i in range(200)
    ], [{"session_id": f"s{i % 4}", "insertions": i} for i in range(8)])
    other = Workspace(traces=ws.traces.repartition(13, "id"), git=ws.git.repartition(7), findings=ws.findings)
    for fn in (S.rollups, D.stumbles, D.productivity_rows, O.motifs, S.session_activity):
        a, b = fn(ws), fn(other)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_empty_tables(spark):
    ws = workspace(spark, [])
    for fn in (O.stats, S.rollups, D.productivity_score, C.comparison_range, U.autonomy_summary, X.findings_by_pattern,
               C.commit_density, U.heatmap_matrix, U.validation_summary):
        fn(ws).collect()
    assert O.stats(ws).first()["total_entries"] == 0


def test_cells_of_few_intervals_are_cut_in_many_tasks(spark):
    """Intervals are small and their cells are not: adaptive execution must not put them together."""
    points = spark.createDataFrame([("p", 5), ("p", 90_000_000_000), ("q", 5)], "k string, at long")
    ranges = spark.createDataFrame([("p", 0, 80_000_000_000, "b"), ("p", 5, 5, "a"), ("q", 6, 9, "a"), (None, 0, 9, "a")], "k string, lo long, hi long, best string")
    found = I.first_covering(points, ranges, "k", "at", "lo", "hi", "best")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert [tuple(r) for r in found.collect()] == [("p", 5, "a")]
