"""Load jobs hold no more than they need: what they stage goes, and commits move once."""

import os

import pytest
from helpers import traces
from pyspark.sql import functions as F
from test_jobs import chunks

from spoor import session
from spoor.operators import attribution, runs
from spoor.plans import jobs, lake, loads
from spoor.sources import gitlog, raw


@pytest.fixture
def folder(monkeypatch, tmp_path):
    made = []

    def work_folder(_, name):
        made.append(f"{tmp_path}/work/{name}-{len(made)}")
        return made[-1]

    monkeypatch.setattr(session, "work_folder", work_folder)
    return tmp_path / "work"


def left(folder):
    return [f for _, _, files in os.walk(folder) for f in files if f.endswith(".parquet")]


def test_a_scan_leaves_no_tables_and_moves_narrow_rows(spark, tmp_path, folder, monkeypatch):
    given, whole = [], attribution.attribute_at_scan
    monkeypatch.setattr(attribution, "attribute_at_scan", lambda git, t: given.append(git.columns) or whole(git, t))
    out = str(tmp_path / "git_events")
    seen = traces(spark, [{"session_id": "s1", "ts": "2026-01-05T09:59:00Z"}, {"session_id": "s1", "ts": "2026-01-05T10:01:00Z"}])
    first = [("a1", "ann", "2026-01-05"), ("a2", "ann", "2026-01-09"), ("a1", "ann", "2026-01-05")]  # one comes twice
    more = first + [("b1", "bob", "2026-01-05"), ("b1", "bob", "2026-01-05"), ("b2", "bob", "no day")]
    for commits, want in ((first, ["a1", "a2"]), (more, ["a1", "a2", "b1", "b2"]), (more, ["a1", "a2", "b1", "b2"])):
        jobs.scan_git(chunks(spark, commits), seen, out, "full")
        rows = lake.read_git(spark, out).collect()
        assert sorted(r.commit_sha for r in rows) == want and left(folder) == []
    assert {r.commit_sha: (r.session_id, r.message, r.files) for r in rows} == {
        "a1": ("s1", "fix", ["a.py"]), "b1": ("s1", "fix", ["a.py"]), "a2": (None, "fix", ["a.py"]), "b2": (None, "fix", ["a.py"])}
    assert len(given) == 3 and not any({"message", "files", "message_body"} & set(c) for c in given)
    assert spark.conf.get(runs.DROPPED, None) in (None, "false")


def test_staged_rows_go_when_a_job_breaks_off(spark, folder):
    with pytest.raises(ZeroDivisionError):
        with runs.passing(spark):
            assert runs.staged(spark.range(3), "x").count() == 3 and left(folder)
            1 / 0
    assert left(folder) == [] and runs.staged(spark.range(3), "y").count() == 3 and left(folder)


@pytest.mark.parametrize("name", ["git_scan_twice", "git_scan_developers", "git_late_branch"])
def test_history_is_made_once_for_all_captures(spark, name, monkeypatch):
    read, scan = [], jobs.scan_git
    monkeypatch.setattr(jobs, "scan_git", lambda chunks, *a, **kw: read.extend(chunks.inputFiles()) or scan(chunks, *a, **kw))
    rows = getattr(loads, name)(spark, "/root/testdata/sf0.001")
    assert rows.groupBy("commit_sha").count().where(F.col("count") > 1).count() == 0 and rows.count() > 0
    assert read and not any(f.endswith(("/orders.parquet", "/lineitem.parquet")) or "/orders.parquet/" in f for f in read)


def test_an_author_is_told_without_cutting_the_chunk_again(spark):
    rows = attribution.filter_author(gitlog.parse(chunks(spark, [("a1", "ann", "2026-01-05"), ("b1", "bob", "2026-01-05")]).repartition(2)), "ann")
    assert [(r.commit_sha, r.files, r.insertions) for r in rows.collect()] == [("a1", ["a.py"], 1)]
    steps = rows._jdf.queryExecution().optimizedPlan().toString().split("+- ")
    told = [x for x in steps if x.startswith("Filter") and "Contains(lower" in x]
    assert told and not any("GIT_EVENT_FIELD" in x for x in told)


def test_logs_are_opened_once_a_load(spark, tmp_path, folder, monkeypatch):
    seen, read = spark.sparkContext.accumulator(0), raw.read_lines

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(raw, "read_lines", lambda *a, **kw: read(*a, **kw).withColumn("line", counted("line")))
    said = '{"type":"response_item","timestamp":"2024-01-01T00:00:00.000Z","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"do %d"}]}}'
    for i in range(3):
        os.makedirs(f"{tmp_path}/logs/session_key={i}")
        with open(f"{tmp_path}/logs/session_key={i}/l{i}.txt", "w") as f:
            f.write('{"type":"session_meta","payload":{"cwd":"/dev/p%d"}}\n' % i * (i > 0) + said % i + "\n")
    for times in (1, 2):
        jobs.load_logs(spark, f"{tmp_path}/logs", "codex", f"{tmp_path}/traces", "full")
        assert seen.value == 5 * times and left(folder) == []
        got = lake.read_traces(spark, f"{tmp_path}/traces").collect()
        assert sorted((r.session_id, r.project, r.user_prompt) for r in got) == [("l0", "unknown", "do 0"), ("l1", "p1", "do 1"), ("l2", "p2", "do 2")]
