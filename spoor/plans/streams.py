"""The streaming jobs run to the end of what is there, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import schema as S
from spoor import session
from spoor.plans import lake, samples, views
from spoor.streaming import ingest, live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(known).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.conform(views.traces(spark, sf_dir, _events(spark, sf_dir)), S.TRACES)


def _run(df: DataFrame, name: str) -> DataFrame:
    """Append what the stream gives to Parquet and read it back."""
    spark = df.sparkSession
    base = session.work_folder(spark, name)
    q = (
        df.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _keep(counters: DataFrame, name: str) -> DataFrame:
    spark = counters.sparkSession
    base = session.work_folder(spark, name)
    live.keep_table(counters, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return live.read_table(spark, f"{base}/out", counters.schema)


def live_sessions(spark, sf_dir):
    base = session.work_folder(spark, "sessions")
    live.keep_sessions(_traces(spark, sf_dir), f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return live.read_sessions(spark, f"{base}/out")


def _delivered(spark, sf_dir, base, parts):
    """The traces as a stream of ``parts`` micro-batches, in no order of time."""
    rows = S.conform(views.traces(spark, sf_dir), S.TRACES)
    for i in range(parts):
        rows.where(F.crc32(F.col("id").cast("binary")) % parts == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def live_sessions_out_of_order(spark, sf_dir):
    """Stretches of activity after micro-batches that each hold some rows of every time."""
    base = session.work_folder(spark, "sessions")
    stream = _delivered(spark, sf_dir, base, 5)
    live.keep_sessions(stream, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return live.read_sessions(spark, f"{base}/out")


def live_counters_many_epochs(spark, sf_dir):
    """Counters after twenty micro-batches; the lateness covers the whole range."""
    base = session.work_folder(spark, "counters")
    counters = live.token_counters(_delivered(spark, sf_dir, base, 20), "60 days")
    live.keep_table(counters, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return live.read_table(spark, f"{base}/out", counters.schema)


def live_token_counters(spark, sf_dir):
    return _keep(live.token_counters(_traces(spark, sf_dir)), "tokens")


def live_finding_counters(spark, sf_dir):
    return _keep(live.finding_counters(_traces(spark, sf_dir)), "findings")


def admit_stream(spark, sf_dir):
    return _run(ingest.admit(samples.requests(spark, sf_dir, _events(spark, sf_dir))), "admit").agg(
        F.countDistinct("nonce").alias("nonces"))


def ingest_stream(spark, sf_dir):
    """Envelopes, a third of them sent twice, landed once."""
    base = session.work_folder(spark, "ingest")
    sent = samples.batches(spark, sf_dir).drop("user_id", "day")
    sent.select(F.to_json(F.struct(*sent.columns)).alias("value")).write.text(f"{base}/inbox")
    lines = ingest.read_lines(spark, f"{base}/inbox")
    ingest.land(ingest.parse_batches(lines), None, f"{base}/raw", f"{base}/state", available_now=True).awaitTermination()
    landed = lake.read_batches(spark, f"{base}/raw")
    return landed.select("developer", "batchId", "year", "month", "day", "agent", "dev",
                         F.size("entries").cast("bigint").alias("entries"))


QUERIES = {f.__name__: f for f in (live_sessions, live_sessions_out_of_order, live_counters_many_epochs, live_token_counters, live_finding_counters, admit_stream, ingest_stream)}
