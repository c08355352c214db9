"""Loads compute their input once, and lines are not moved to be numbered."""

import datetime as dt

from pyspark.sql import functions as F

from spoor import schema as S
from spoor.operators import runs
from spoor.plans import lake
from spoor.sources import raw


def test_rows_are_told_apart_in_one_pass(spark):
    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("a", at, day[0]), ("a", at, day[0]), ("a", at, day[1]), ("a", None, day[2]), ("a", None, day[1]), ("b", None, day[2]), (None, None, day[2]), (None, at, day[0]), (None, at, day[0])]
    once = lake._once(spark.createDataFrame(rows, "id string, ts timestamp, event_date date"))
    key = lambda r: (r[0] or "", r[1] is not None, r[2])
    want = [("a", at, day[0]), ("a", at, day[1]), ("a", None, day[1]), ("b", None, day[2]), (None, None, day[2]), (None, at, day[0])]
    assert sorted(map(key, once.collect())) == sorted(map(key, want))
    assert "Union" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_batches_are_computed_once_a_load(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    line = '{"type":"%s","timestamp":"2024-01-01T00:00:0%d.000Z","payload":{"type":"message","role":"user","model":"g","content":[{"type":"input_text","text":"do"}]}}'
    batches = spark.createDataFrame([(f"b{i}", "d", "codex", f"/logs/l{i}.jsonl", [line % ("turn_context", 1), line % ("response_item", 2)]) for i in range(3)],
                                    "batchId string, developer string, agent string, sourceFile string, entries array<string>")
    lake.repartition_by_event(S.conform(batches, S.BATCH).withColumn("developer", counted("developer")), f"{tmp_path}/traces", "full", models=f"{tmp_path}/models")
    assert seen.value == 3
    assert [(r.developer, r.model) for r in lake.read_traces(spark, f"{tmp_path}/traces").collect()] == [("d", "g")] * 3


def test_lines_are_numbered_without_their_text(spark, monkeypatch):
    given, numbered = [], runs.numbered
    monkeypatch.setattr(runs, "numbered", lambda rows, *a, **kw: given.append(rows.columns) or numbered(rows, *a, **kw))
    lines = spark.createDataFrame([("/l", "d", "m", "p", 0, i, '{"n":%d}' % i) for i in range(40)] + [(None, "d", "m", "p", 0, 1, "{broken"), (None, "d", "m", "p", 0, 2, "{}")],
                                  "source string, developer string, machine string, project string, chunk int, seq int, line string")
    got = {r.sourceFile: r.entries for r in raw.to_batches(lines, "claude_code", max_entries=40, max_bytes=10_000, block=64).collect()}
    assert got == {"/l": ['{"n":%d}' % i for i in range(40)], "": ["{}"]}
    assert len(given) == 1 and "line" not in given[0]
