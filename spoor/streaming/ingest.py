"""Arrival: admission, tenant check, idempotent landing, normalisation."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spoor import fixed_values as V
from spoor import schema as S
from spoor.functions import json as J
from spoor.operators import governance, runs
from spoor.plans import derived, lake
from spoor.sources import normalised


def _start(writer, available_now: bool, every: str | None) -> StreamingQuery:
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def read_lines(spark: SparkSession, path: str, max_files: int | None = None,
               max_bytes: int | None = V.BATCH_MAX_BYTES) -> DataFrame:
    """Whole lines of landed chunk files as a stream (line, source, modified_at).

    A file is read once, so a growing log has to land as chunks that do not change.
    Each micro-batch takes a bounded number of files or bytes; one file larger than
    the bound comes alone.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_modification_time").alias("modified_at"))


def parse_batches(lines: DataFrame) -> DataFrame:
    """Shipped envelopes (JSON lines) to batches. The developer defaults to
    'unknown'; an envelope without entries drops out."""
    v = F.col("v")
    rows = lines.withColumn("v", J.parse(F.col("line"))).withColumn("entries", J.strings(v, "$.entries"))
    keep = [c for c in lines.columns if c not in ("line", "source")]
    names = [f.name for f in S.BATCH.fields if f.name not in ("entries", "developer")]
    return rows.where(F.col("entries").isNotNull()).select(
        *keep, *[J.text(v, f"$.{n}").alias(n) for n in names if n not in keep],
        F.coalesce(J.loose_text(v, "$.developer"), F.lit("unknown")).alias("developer"), "entries")


def admit(requests: DataFrame, skew_seconds: int = V.REPLAY_WINDOW_SECONDS, nonce_ttl: str = V.NONCE_TTL) -> DataFrame:
    """Drop requests whose clock is off and those that repeat a nonce.

    requests: received_at (timestamp), sent_at (epoch seconds), nonce. A request
    that arrives later than the nonce lifetime behind the newest is dropped too.
    """
    off = F.abs(F.unix_seconds("received_at") - F.col("sent_at"))
    fresh = requests.where(off <= skew_seconds)
    if not requests.isStreaming:
        return _admit_in_time(fresh, nonce_ttl)
    return fresh.withWatermark("received_at", nonce_ttl).dropDuplicatesWithinWatermark(["nonce"])


def _admit_in_time(fresh: DataFrame, nonce_ttl: str) -> DataFrame:
    """A nonce is free again once its lifetime has passed since it was last admitted.

    Requests of a nonce are cut into stretches without a gap of a lifetime; the first of a
    stretch is admitted, and of the rest those that lie a lifetime after the last admitted. Of requests at one instant one stays.
    """
    life = F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {nonce_ttl}"))
    one = fresh.dropDuplicates(["nonce", "received_at"]).withColumn("_us", F.unix_micros("received_at"))
    by = W.partitionBy("nonce").orderBy("_us")
    gap = F.col("_us") - F.lag("_us").over(by)
    cut = one.withColumn("_new", F.coalesce(gap >= life, F.lit(True)).cast("int")).withColumn("_stretch", F.sum("_new").over(by))
    times = cut.groupBy("nonce", "_stretch").agg(F.array_sort(F.collect_list("_us")).alias("_all"))
    admitted = F.aggregate("_all", F.array().cast("array<bigint>"), lambda acc, t: F.when(
        (F.size(acc) == 0) | (t - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) >= life), F.concat(acc, F.array(t))).otherwise(acc))
    kept = times.select("nonce", F.explode(admitted).alias("_us"))
    return one.join(kept, ["nonce", "_us"]).select(*fresh.columns)


def land(batches: DataFrame, credentials: DataFrame | None, path: str, checkpoint: str,
         available_now: bool = False, every: str | None = None, rejects: str | None = None) -> StreamingQuery:
    """Land each batch once. A micro-batch that runs again finds its rows landed
    and adds nothing: a batch is one row, so it is there whole or not at all.

    Ids are looked up in a table by developer, of which only the folders of the developers
    in the micro-batch are listed; see ``lake.landed_ids``. Batches that their credential does not cover go to the
    table ``rejects``, if given, under the number of the micro-batch.
    """
    spark = batches.sparkSession

    def write(df: DataFrame, epoch: int) -> None:
        rows = runs.staged(df, "arrived")
        if credentials is not None:
            bound = governance.bind_tenant(rows, credentials)
            if rejects:
                refused = bound.where(~F.coalesce(F.col("accepted"), F.lit(False))).drop("accepted", "credential")
                S.conform(refused, S.BATCH).write.mode("overwrite").parquet(f"{rejects}/epoch={epoch}")
            rows = bound.where("accepted").drop("accepted", "credential")
        sent = lake.with_ship_partition(lake.with_batch_ids(S.conform(rows, S.BATCH)))
        if lake.exists(spark, path) and not lake.exists(spark, f"{path}_ids"):  # landed before there was an id table
            lake.note_ids(lake.read_batches(spark, path), path)
        fresh = runs.staged(S.conform(lake.new_batches(rows, lake.landed_ids(sent, path)), S.BATCH), "landing")
        lake.land_batches(fresh, path)
        lake.note_ids(lake.with_ship_partition(fresh), path)

    writer = batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _start(writer, available_now, every)


def stream_logs(spark: SparkSession, zone: str, out: str, checkpoint: str, disclosure: str, redact: bool = True,
                available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Landed vendor batches to the traces of ``out`` as they arrive, in any order of
    deliveries. What a log carries from batch to batch is a table beside the traces; see
    ``lake.repartition_by_event``, which runs for each micro-batch and may run again."""
    stream = spark.readStream.schema(lake.batch_schema()).parquet(zone)

    def write(rows: DataFrame, epoch: int) -> None:
        lake.repartition_by_event(S.conform(rows, S.BATCH), f"{out}/traces", disclosure, redact, models=f"{out}/models", zone=zone)

    return _start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, every)


def normalise(lines: DataFrame, out: str, checkpoint: str, disclosure: str, redact: bool = True,
              available_now: bool = False, every: str | None = None) -> StreamingQuery:
    """Normalised JSON lines to the governed Parquet zone, append only. Rows without a time
    are filed under the date of their file."""
    dated = lines.select("line", *([F.to_date("modified_at").alias("event_date")] if "modified_at" in lines.columns else []))
    rows = lake.govern(normalised.parse_traces(dated), disclosure, redact)
    rows = lake.with_event_date(rows, modified_at=F.col("event_date") if "event_date" in rows.columns else None)
    writer = (
        rows.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).partitionBy("event_date", "agent")
    )
    return _start(writer, available_now, every)


def keep_fresh(spark: SparkSession, out: str, checkpoint: str, available_now: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Keep what is derived from the traces of ``out`` up to date as files appear: a
    micro-batch refreshes the partitions its files lie in. Its first one meets all files
    that are there, unless the checkpoint knows them."""
    stream = spark.readStream.schema(T.StructType([*S.TRACES.fields, T.StructField("event_date", T.DateType())])).parquet(f"{out}/traces")
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def refresh(rows: DataFrame, epoch: int) -> None:
        derived.refresh(spark, out, derived.touched_by(rows), f"{name}.{epoch}")

    return _start(stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint), available_now, every)


def on_change(spark: SparkSession, path: str, refresh, checkpoint: str, available_now: bool = False,
              every: str = "3 seconds") -> StreamingQuery:
    """Call ``refresh(new_rows, epoch)`` for files that appear in a lake path; the
    trigger interval gathers bursts into one call."""
    stream = spark.readStream.schema(S.TRACES).parquet(path)
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return _start(writer, available_now, every)
