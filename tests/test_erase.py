"""Erasing by file, and landing by developer."""

import datetime as dt
from urllib.parse import unquote, urlparse

import pytest
from helpers import git, rows, traces
from pyspark.sql import functions as F

from spoor import schema as S
from spoor.plans import derived, lake
from spoor.streaming import ingest


def entry(i, who, day, **more):
    return {"id": i, "developer": who, "agent": "codex", "session_id": f"s-{who}", "ts": f"2026-01-0{day}T10:00:00Z", "stdout": "[REDACTED:jwt_token]"} | more


ROWS = [entry("a1", "ann", 1), entry("a2", "ann", 2), entry("b1", "bob", 1), entry("b2", "bob", 3), entry("n", None, 3)]


def built(spark, out):
    for r in ROWS:  # a file for each row
        lake.write_traces(lake.with_event_date(traces(spark, [r])), f"{out}/traces")
    commits = [{"commit_sha": "x", "ts": "2026-01-02T10:01:00Z", "author": "Cy"}, {"commit_sha": "y", "ts": "2026-01-02T10:02:00Z", "author": "ANN"}]
    lake.write_git(git(spark, commits), f"{out}/git_events")
    derived.build(spark, out)
    derived.refresh(spark, out, derived.touched_by(lake.read_traces(spark, f"{out}/traces")))
    links = spark.createDataFrame([("ann", "l1"), ("bob", "l2")], "_developer string, _session string")
    for i in (0, 1):
        links.limit(i + 1).subtract(links.limit(i)).write.mode("append").parquet(f"{out}/models")


def files(spark, out):
    return set(lake.read_traces(spark, f"{out}/traces").select("_metadata.file_path").distinct().toPandas().file_path)


def test_only_files_that_hold_the_developer_are_written_again(spark, tmp_path):
    out = str(tmp_path / "out")
    built(spark, out)
    held = files(spark, out)
    counts = lake.erase(spark, out, "ann")
    assert counts == {"traces": (2, 2), "git_events": (1, 1), "models": (1, 1)}
    assert len(held & files(spark, out)) == 3
    assert sorted(rows(lake.read_traces(spark, f"{out}/traces"), "id")) == [("b1",), ("b2",), ("n",)]
    found = lake.read_findings(spark, f"{out}/findings")
    assert sorted(rows(found, "source_id", "event_date")) == [("b1", dt.date(2026, 1, 1)), ("b2", dt.date(2026, 1, 3)), ("n", dt.date(2026, 1, 3))]
    assert rows(lake.read_git(spark, f"{out}/git_events"), "commit_sha") == [("x",)] and rows(spark.read.parquet(f"{out}/models"), "_session") == [("l2",)]
    assert rows(derived.totals(spark, out).where("kind = 'pattern'"), "n") == [(3,)]
    assert lake.erase(spark, out, "ann") == {"traces": (0, 0), "git_events": (0, 0), "models": (0, 0)}


@pytest.mark.parametrize("step", ["_finish", "refresh"])
def test_an_erasure_that_broke_off_is_finished(spark, tmp_path, monkeypatch, step):
    out = str(tmp_path / "out")
    built(spark, out)
    where = {"_finish": lake, "refresh": derived}[step]
    whole, calls = getattr(where, step), []

    def broken(*args):
        calls.append(args)
        if step == "refresh" or len(calls) == 3:  # the call after all is staged
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(where, step, broken)
    with pytest.raises(RuntimeError):
        lake.erase(spark, out, "ann")
    monkeypatch.setattr(where, step, whole)
    lake.erase(spark, out, "ann")
    assert sorted(rows(lake.read_traces(spark, f"{out}/traces"), "id")) == [("b1",), ("b2",), ("n",)]
    assert sorted(rows(lake.read_findings(spark, f"{out}/findings"), "source_id")) == [("b1",), ("b2",), ("n",)]


def test_landing_lists_no_other_developer(spark, tmp_path):
    zone = str(tmp_path / "raw")

    def sent(i, *rows_):
        path = str(tmp_path / f"in{i}")
        batch = [(b, who, "h", "codex", "p", "/l", at, None, [b]) for b, who, at in rows_]
        spark.createDataFrame(batch, S.BATCH).coalesce(1).write.parquet(path)
        ingest.land(spark.readStream.schema(S.BATCH).parquet(path), None, zone, str(tmp_path / f"cp{i}"), available_now=True).awaitTermination(120)

    day = "2026-01-0{}T00:00:00Z"
    sent(0, ("1", "ann", day.format(1)), ("2", "ann", day.format(1)), ("1", "bob", day.format(1)))
    other = lake.read_batches(spark, zone).where("developer = 'bob'").select("_metadata.file_path").first()[0]
    with open(unquote(urlparse(other).path), "w") as f:  # reading it would fail
        f.write("no parquet")
    sent(1, ("2", "ann", day.format(4)), ("3", "ann", day.format(1)))  # one shipped again on another day
    got = lake.read_batches(spark, zone).where(F.col("dev") == lake._dev("ann"))
    assert sorted(rows(got, "batchId")) == [("1",), ("2",), ("3",)]


def test_a_landing_that_broke_off_lands_once(spark, tmp_path, monkeypatch):
    zone, path = str(tmp_path / "raw"), str(tmp_path / "in")
    spark.createDataFrame([("1", "ann", "h", "codex", "p", "/l", "2026-01-01T00:00:00Z", None, ["x"])], S.BATCH).write.parquet(path)

    def run():
        stream = spark.readStream.schema(S.BATCH).parquet(path)
        ingest.land(stream, None, zone, str(tmp_path / "cp"), available_now=True).awaitTermination(120)

    whole = lake.note_ids
    monkeypatch.setattr(lake, "note_ids", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(lake, "note_ids", whole)
    run()
    assert rows(lake.read_batches(spark, zone), "batchId") == [("1",)]
