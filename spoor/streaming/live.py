"""Live sessions, counters and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spoor.functions import clock, tokens
from spoor.operators.security import extract_findings
from spoor.streaming import state


def _watermarked(df: DataFrame, lateness: str) -> DataFrame:
    return df.withWatermark("ts", lateness) if df.isStreaming else df


def sessions(traces: DataFrame, lateness: str = "1 hour", gap: str = "5 minutes") -> DataFrame:
    """Stretches of activity per session; on a stream a stretch comes out once the
    watermark is past its end. Active time of a session is the sum over its
    stretches of last minus first entry.

    Rows of one session meet per partition before the shuffle when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on.
    """
    return (
        _watermarked(traces.where(F.col("session_id").isNotNull() & F.col("ts").isNotNull()), lateness)
        .groupBy("session_id", F.session_window("ts", gap).alias("w"))
        .agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("entries"))
        .select("session_id", "started", "ended", "entries",
                (clock.ms(F.col("ended")) - clock.ms(F.col("started"))).alias("active_ms"))
    )


def with_open_sessions(closed: DataFrame, traces: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """The stretches a stream of ``sessions`` has given out, and those its watermark has not
    passed yet, made of the rows after the last closed one of their session; ``traces`` is
    the table that the stream reads. ``keep_sessions`` needs no such second reading."""
    last = closed.groupBy("session_id").agg(F.max("ended").alias("_last"))
    rest = traces.join(last, "session_id", "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last")))
    return closed.unionByName(sessions(rest, gap=gap))


#: Parts of a day's sessions that are replaced on their own.
BUCKETS = 8
GAP = 300_000_000
_SEGMENT = ["date", "bucket", "session_id", "lo", "hi", "entries"]


def _joined(segments: DataFrame, *within: str) -> DataFrame:
    """Segments of a session no further apart than the gap become one: ``within``,
    session_id, lo, hi (microseconds), entries."""
    by = W.partitionBy(*within, "session_id").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("lo") - reach > GAP, F.lit(True)).cast("int")
    island = F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))
    return (
        segments.withColumn("_new", fresh).withColumn("_island", island).groupBy(*within, "session_id", "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("entries").alias("entries")).drop("_island")
    )


def keep_sessions(traces: DataFrame, path: str, checkpoint: str, available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Keep stretches of activity of a stream of traces as a table, open ones included.

    A micro-batch's instants become segments; they join those of the same session and day
    that the table holds, wherever they fall, so late rows find their stretch. Days are
    joined when read. Only the days and parts of sessions a micro-batch has are rewritten.
    """
    rows = traces.where(F.col("session_id").isNotNull() & F.col("ts").isNotNull()).select("session_id", "ts")

    def write(df: DataFrame, epoch: int) -> None:
        at = F.unix_micros("ts")
        instants = df.groupBy("session_id", at.alias("lo")).agg(F.count(F.lit(1)).alias("entries"))
        dated = instants.select(F.to_date(F.timestamp_micros("lo")).alias("date"), F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
                                "session_id", "lo", F.col("lo").alias("hi"), "entries")
        state.upsert(_in_slots(dated).select(*_SEGMENT), path, epoch, ["date", "bucket"], lambda both: _joined(both, "date", "bucket"))

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _started(writer, available_now, every)


def _in_slots(instants: DataFrame) -> DataFrame:
    """Instants joined inside slots of an hour first, so that no window holds a hot session's
    day; what is left of a slot is few, each further than the gap from the next."""
    slotted = instants.withColumn("slot", F.floor(F.col("lo") / 3_600_000_000))
    return _joined(_joined(slotted, "date", "bucket", "slot"), "date", "bucket")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The stretches that ``keep_sessions`` keeps, as ``sessions`` gives them."""
    schema = T.StructType([T.StructField("session_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("lo", "hi", "entries")],
                           T.StructField("date", T.DateType()), T.StructField("bucket", T.IntegerType())])
    rows = _joined(state.read(spark, path, schema, ["date", "bucket"]))
    return rows.select("session_id", F.timestamp_micros("lo").alias("started"), F.timestamp_micros("hi").alias("ended"), "entries",
                       (F.floor(F.col("hi") / 1000) - F.floor(F.col("lo") / 1000)).alias("active_ms"))


def token_counters(traces: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Rows and tokens per day and agent."""
    return (
        _watermarked(traces.where(F.col("ts").isNotNull()), lateness)
        .groupBy(F.window("ts", "1 day").alias("w"), "agent")
        .agg(F.count(F.lit(1)).alias("count"), tokens.sum_total().alias("total_tokens"))
        .select(F.to_date("w.start").alias("date"), "agent", "count", "total_tokens")
    )


def finding_counters(traces: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Redaction markers per day and pattern. Rows without a marker still move the
    watermark."""
    return (
        extract_findings(_watermarked(traces, lateness))
        .groupBy(F.window("ts", "1 day").alias("w"), "pattern_type").agg(F.count(F.lit(1)).alias("count"))
        .select(F.to_date("w.start").alias("date"), "pattern_type", "count")
    )


def _started(writer, available_now: bool, every: str | None) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def keep_table(counters: DataFrame, path: str, checkpoint: str, available_now: bool = False,
               every: str | None = None, unit: str = "date") -> StreamingQuery:
    """Keep counters of a stream as a table. A micro-batch brings the groups that it changed,
    with all they have come to, and rewrites the days (``unit``) they belong to; one that
    runs again replaces what it wrote."""
    keys = [c for c in counters.columns if c not in VALUES]

    def write(rows: DataFrame, epoch: int) -> None:
        state.upsert(rows.withColumn("epoch", F.lit(epoch).cast("bigint")), path, epoch, [unit], lambda both: state.counted(both, keys))

    return _started(counters.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), available_now, every)


#: Columns of counters that are no key.
VALUES = ("count", "total_tokens")


def read_table(spark: SparkSession, path: str, schema: T.StructType, *keys: str, unit: str = "date") -> DataFrame:
    """The latest state of every group that ``keep_table`` wrote, open windows included. A
    table holds a group once, so its ``keys`` need not be given."""
    return state.read(spark, path, T.StructType([*schema.fields, T.StructField("epoch", T.LongType())]), [unit]).select(*schema.names)
