"""Load jobs over a table that developers share."""

import random

import pytest
from helpers import traces
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.operators import intervals, runs
from spoor.plans import jobs, lake
from spoor.sources import raw


def chunks(spark, commits):
    rows = [(V.COMMIT_FIELD.join([sha, "p1", who, f"{who}@x.com", f"{day}T10:00:00Z", "fix", ""]) + "\n1\t0\ta.py\n",) for sha, who, day in commits]
    return spark.createDataFrame(rows, "chunk string").select(
        "chunk", *[F.lit(v).alias(k) for k, v in {"project": "p", "repo": "o/r", "developer": "d", "machine": "m", "repo_path": "/r"}.items()])


@pytest.mark.parametrize("tier", ["basic", "full"])
def test_git_scans_of_two_developers(spark, tmp_path, tier):
    early = [("a1", "ann", "2026-01-05"), ("a2", "ann", "2026-01-09"), ("b1", "bob", "2026-01-02"), ("b2", "bob", "2026-01-07"), ("c1", "cy", "2026-01-01")]
    late = [("a3", "ann", "2026-01-10"), ("b3", "bob", "2026-01-08")]
    out, none = str(tmp_path / "git_events"), traces(spark, [])
    held = lambda: sorted(r.commit_sha for r in lake.read_git(spark, out).collect())
    for who, commits, want in (("ann", early, ["a1", "a2"]), ("bob", early, ["a1", "a2", "b1", "b2"]), ("ann", early + late, ["a1", "a2", "a3", "b1", "b2"]),
                               (None, early + late, ["a1", "a2", "a3", "b1", "b2", "b3", "c1"])):
        jobs.scan_git(chunks(spark, commits), none, out, tier, who)
        assert held() == want


def plain_cut(sizes, max_rows, max_bytes):
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= max_rows or held + size > max_bytes):
            start, held = i, 0
        out.append(start)
        held += size
    return out


@pytest.mark.parametrize("max_rows,max_bytes,block", [(5, 40, 5), (5, 40, 8), (7, 10_000, 16), (3, 1, 64), (6, 60, 1 << 16)])
def test_cuts_follow_one_another_over_blocks(spark, max_rows, max_bytes, block):
    rng = random.Random(max_rows)
    logs = {"hot": [rng.choice([0, 1, 3, 9, 15, 41, 200]) for _ in range(700)], "even": [4] * 150, "one": [99], "few": [1, 2, 3, 50, 4]}
    rows = [(k, i, s) for k, sizes in logs.items() for i, s in enumerate(sizes)]
    got = {}
    for r in runs.cut(spark.createDataFrame(rows, "key string, pos long, size long").repartition(3), max_rows, max_bytes, block).collect():
        assert (r.key, r.pos) not in got
        got[r.key, r.pos] = r.start
    assert got == {(k, i): s for k, sizes in logs.items() for i, s in enumerate(plain_cut(sizes, max_rows, max_bytes))}


def test_numbered_rows(spark):
    rows = [(["a", "b", None][i % 3] if i > 300 else "hot", i * 7 % 1000) for i in range(1000)]
    got = runs.numbered(spark.createDataFrame(rows, "k string, v long").repartition(5), ["k"], ["v"], "place").collect()
    for k in ("hot", "a", "b", None):
        own = sorted(v for x, v in rows if x == k)
        assert sorted((r.place, r.v) for r in got if r.k == k) == list(enumerate(own))


def test_batches_of_logs_that_grew(spark):
    def lines(n):
        rows = [("/l/a.jsonl", 0, i, f' {{"n":{i}}} ' if i % 7 else "no json") for i in range(n)] + [("/l/b.jsonl", 0, 0, '{"big":"' + "x" * 500 + '"}'), ("/l/b.jsonl", 1, 0, "{}")]
        return spark.createDataFrame(rows, "source string, chunk int, seq int, line string").withColumns({c: F.lit(c) for c in ("developer", "machine", "project")})

    early, late = ({r.batchId: list(r.entries) for r in raw.to_batches(lines(n), "codex", max_entries=10, max_bytes=300).collect()} for n in (35, 60))
    assert [x for b in sorted(late.values(), key=lambda b: len(b[0])) if "big" not in b[0] and b != ["{}"] for x in b] and all(len(b) <= 10 for b in late.values())
    full = {k for k, v in early.items() if len(v) == 10}
    assert full and all(late[k] == early[k] for k in full)
    assert sorted(x for b in late.values() for x in b) == sorted([f'{{"n":{i}}}' for i in range(60) if i % 7] + ['{"big":"' + "x" * 500 + '"}', "{}"])


def test_commits_of_days_long_past_are_filed(spark, tmp_path):
    out, none = str(tmp_path / "git_events"), traces(spark, [])
    early = [("a1", "ann", "2026-01-05"), ("a2", "ann", "2026-01-09")]
    late = [("a9", "ann", "2026-01-07"), ("b9", "bob", "2026-01-05")]  # of an uncovered and of a covered day
    for commits, want in ((early, ["a1", "a2"]), (early + late, ["a1", "a2", "a9", "b9"]), (early + late, ["a1", "a2", "a9", "b9"])):
        jobs.scan_git(chunks(spark, commits), none, out, "basic")
        assert sorted(r.commit_sha for r in lake.read_git(spark, out).collect()) == want
    assert [(r.lo.isoformat(), r.hi.isoformat()) for r in jobs.git_gaps(spark, out, "2026-01-04", "2026-01-10").orderBy("lo").collect()] == [
        ("2026-01-04", "2026-01-04"), ("2026-01-06", "2026-01-06"), ("2026-01-08", "2026-01-08"), ("2026-01-10", "2026-01-10")]


def test_a_scan_that_broke_off_runs_again(spark, tmp_path, monkeypatch):
    out, none = str(tmp_path / "git_events"), traces(spark, [])
    jobs.scan_git(chunks(spark, [("a1", "ann", "2026-01-05")]), none, out, "full")
    both = chunks(spark, [("a1", "ann", "2026-01-05"), ("a2", "ann", "2026-01-06")])
    whole = lake.write_git

    def broken(git, path):
        whole(git, path)
        raise RuntimeError("lost")

    monkeypatch.setattr(lake, "write_git", broken)
    with pytest.raises(RuntimeError):
        jobs.scan_git(both, none, out, "full")
    monkeypatch.setattr(lake, "write_git", whole)
    jobs.scan_git(both, none, out, "full")
    assert sorted(r.commit_sha for r in lake.read_git(spark, out).collect()) == ["a1", "a2"]


def test_ranges_merge_and_leave_gaps(spark):
    rng = random.Random(2)
    rows = [(k, lo, lo + rng.randrange(4)) for k in "ab" for lo in (rng.randrange(60) for _ in range(14))]
    df = spark.createDataFrame(rows, "k string, lo long, hi long")
    held = {k: {d for x, lo, hi in rows if x == k for d in range(lo, hi + 1)} for k in "ab"}

    def days(out):
        got = [(r.k, d) for r in out.collect() for d in range(r.lo, r.hi + 1)]
        assert len(got) == len(set(got))
        return {k: {d for x, d in got if x == k} for k in "ab"}

    assert days(intervals.merged(df, ["k"])) == held
    assert days(intervals.gaps(df, ["k"], F.lit(5), F.lit(50))) == {k: set(range(5, 51)) - held[k] for k in "ab"}
