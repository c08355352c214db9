"""Tables that streams keep: read and write cost do not grow with the epochs gone by."""

import random

from helpers import traces
from pyspark.sql import functions as F

from spoor import schema as S
from spoor.plans import lake
from spoor.streaming import live, state


def batches(spark, zone, n):
    rng = random.Random(4)
    rows = [{"id": f"r{i}", "ts": f"2026-01-0{rng.randrange(1, 4)}T{rng.choice([0, 10, 23]):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}Z",
             "session_id": f"s{rng.randrange(4)}", "usage": (i, 1)} for i in range(240)]
    rows += [{"ts": f"2026-01-0{d}T{t}Z", "session_id": "night"} for d, t in ((1, "23:58:00"), (2, "00:01:00"), (2, "00:05:59"), (2, "00:11:00"))]
    rng.shuffle(rows)
    for i in range(n):
        traces(spark, rows[i::n]).coalesce(1).write.mode("append").parquet(zone)
    return traces(spark, rows), spark.readStream.option("maxFilesPerTrigger", 1).schema(S.TRACES).parquet(zone)


def folders(spark, path):
    return lake.glob(spark, f"{path}/epoch=*/date=*")


def test_kept_sessions_equal_batch_in_any_order(spark, tmp_path):
    table, stream = batches(spark, str(tmp_path / "zone"), 6)
    path = str(tmp_path / "out")
    live.keep_sessions(stream, path, str(tmp_path / "cp"), available_now=True).awaitTermination(300)
    got = live.read_sessions(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, live.sessions(table).select(*got.columns).collect()))
    night = got.where("session_id = 'night'").orderBy("started").collect()
    assert [r.entries for r in night] == [3, 1]  # over midnight, and past the gap


def test_versions_of_a_unit_do_not_pile_up(spark, tmp_path):
    table, stream = batches(spark, str(tmp_path / "zone"), 12)
    path = str(tmp_path / "out")
    counters = live.token_counters(stream, "30 days")
    live.keep_table(counters, path, str(tmp_path / "cp"), available_now=True).awaitTermination(300)
    assert len(folders(spark, path)) <= 2 * 3
    got = live.read_table(spark, path, counters.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, live.token_counters(table).collect()))


def test_an_epoch_that_runs_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, n long, date string"

    def add(epoch, *rows):
        state.upsert(spark.createDataFrame(list(rows), schema), path, epoch, ["date"], lambda both: both.groupBy("k", "date").agg(F.sum("n").alias("n")))

    def held():
        return sorted(tuple(r) for r in state.read(spark, path, spark.createDataFrame([], schema).schema, ["date"]).collect())

    add(0, ("a", 1, "x"), ("b", 2, "y"))
    for _ in range(2):
        add(1, ("a", 10, "x"))
    assert held() == [("a", 11, "x"), ("b", 2, "y")]
    lake.delete(spark, f"{path}/epoch=1/_SUCCESS")  # broke off while it wrote
    assert held() == [("a", 1, "x"), ("b", 2, "y")]
    add(1, ("a", 10, "x"))
    add(2, ("c", 5, "x"))
    assert held() == [("a", 11, "x"), ("b", 2, "y"), ("c", 5, "x")]
