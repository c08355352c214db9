"""Session settings that matter for this library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs a shuffle further on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM does not compile methods above 8000 bytes of code. Wide projections
    # (the parsers) exceed that in whole-stage form; past the limit Spark generates
    # split functions instead, which are compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Folders of a tree are listed many to a task.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # Rows of one session meet inside a partition before a streaming shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for state and staged tables, under the shared folder that the
    cluster names in spark.checkpoint.dir. A local session without one uses a temporary
    folder; on a cluster that would be another disk for each executor, so there it is an
    error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/spoor/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spoor-{name.replace('/', '-')}-")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; resources stay the cluster's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local(cores: str = "*", memory: str = "8g", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("spoor")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
