"""Captured ``git log --numstat`` text to commits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor import schema as S
from spoor.functions import clock, text as X
from spoor.operators import attribution, governance


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """source, chunk: one row per commit; the begin marker is the record
    separator, so long histories split across tasks."""
    return spark.read.option("lineSep", V.COMMIT_BEGIN).text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("chunk"))


def parse(chunks: DataFrame) -> DataFrame:
    """Commit chunks to git events. Columns besides ``chunk``: project, repo,
    developer, machine, repo_path."""
    field = re.escape(V.COMMIT_FIELD)
    parts = F.split(X.trim_all(F.col("chunk")), field, -1)

    def part(i: int) -> Column:
        return X.trim_all(F.get("parts", F.lit(i)))

    is_stat = r"^(?:\d+\t|-\t-\t)"
    lines = F.split(F.array_join(F.slice("parts", 7, F.greatest(F.size("parts") - 6, F.lit(0))), V.COMMIT_FIELD), "\n", -1)
    first_stat = F.coalesce(
        F.array_min(F.transform("lines", lambda s, i: F.when(s.rlike(is_stat), i))), F.size("lines"))
    rows = (
        # Exploded, so that conditions on the parts do not each cut the chunk again.
        chunks.withColumn("parts", F.explode(F.array(parts))).where(F.size("parts") >= 6)
        .withColumn("lines", lines).withColumn("cut", first_stat)
        .withColumn("body", X.trim_all(F.array_join(F.slice("lines", F.lit(1), F.col("cut")), "\n")))
        .withColumn("stats", F.filter(
            F.transform(F.slice("lines", F.col("cut") + 1, F.size("lines") - F.col("cut")),
                        lambda s: F.split(X.trim_all(s), "\t", -1)),
            lambda t: F.size(t) >= 3))
    )

    def number(t: Column, i: int) -> Column:
        return F.coalesce(X.captured(t[i], r"^\s*(-?\d+)", "bigint"), F.lit(0).cast("bigint"))

    def total(i: int) -> Column:
        return F.aggregate("stats", F.lit(0).cast("bigint"), lambda acc, t: acc + number(t, i))

    files = F.transform("stats", lambda t: F.array_join(F.slice(t, 3, F.size(t)), "\t"))
    trailers = F.transform(
        F.filter(F.split("body", "\n", -1), lambda s: s.rlike(r"(?i)^Co-Authored-By:\s*.")),
        lambda s: X.trim_all(F.regexp_replace(s, r"(?i)^Co-Authored-By:\s*", "")))
    parents = F.filter(F.split(part(1), " ", -1), lambda s: s != "")

    def some(arr: Column) -> Column:
        return F.when(F.size(arr) > 0, arr)

    sha = part(0)
    rows = rows.withColumn("co", trailers).withColumn(
        "who", attribution.detect_agent(F.col("co"), part(3))).withColumn("paths", files)
    return S.conform(rows.select(
        governance.git_event_id(F.col("repo"), F.lit("commit"), sha).alias("id"),
        part(4).alias("timestamp_text"), clock.parse_ts(part(4)).alias("ts"),
        F.lit("commit").alias("event_type"), "project", "repo", F.lit("").alias("branch"), "developer", "machine",
        sha.alias("commit_sha"), some(parents).alias("parent_shas"),
        F.size("stats").cast("bigint").alias("files_changed"), total(0).alias("insertions"), total(1).alias("deletions"),
        F.col("who.agent_authored").alias("agent_authored"), F.col("who.agent_name").alias("agent_name"),
        X.nonempty(part(2)).alias("author"), X.nonempty(part(3)).alias("author_email"),
        some(F.col("co")).alias("co_authors"), X.nonempty(part(5)).alias("message"), some(F.col("paths")).alias("files"),
        X.nonempty(F.col("body")).alias("message_body"), F.col("repo_path").alias("repo_local"),
    ), S.GIT_EVENTS)
