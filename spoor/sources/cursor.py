"""Key/value exports (agent cursor): composers and their bubbles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import json as J
from spoor.sources import vendor


def _composers(kv: DataFrame) -> DataFrame:
    v = F.col("v")
    made = J.integer(v, "$.createdAt")
    return (
        kv.where(F.col("key").startswith("composerData:"))
        .withColumn("v", J.parse(F.col("value"))).where(v.isNotNull())
        .select(
            J.text(v, "$.composerId").alias("session_id"),
            F.coalesce(F.when(made != 0, F.date_format(F.timestamp_millis(made), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
                       F.lit("")).alias("timestamp_text"),
            # Keys in the order written: read off the text, a parsed object sorts them.
            F.get(F.json_object_keys(F.get_json_object("value", "$.usageData")), F.lit(0)).alias("model"))
        .where(F.col("session_id").isNotNull())
    )


def _bubbles(kv: DataFrame) -> DataFrame:
    return (
        kv.where(F.col("key").startswith("bubbleId:"))
        .withColumn("session_id", F.get(F.split("key", ":", 3), F.lit(1)))
        .withColumn("b", J.parse(F.col("value"))).where(F.col("b").isNotNull())
    )


def infer_projects(kv: DataFrame, home: str) -> DataFrame:
    """session_id, project from the longest path prefix all strings under ``home``
    in a composer's bubbles share.

    Agreement is decided per path position with min = max, so a composer with any
    number of paths reduces to a handful of rows.
    """
    # String values that start like a path; names of fields are followed by a colon.
    literal = rf'(?<!\\)"((?:{re.escape(home)}|file:)[^"]*)"(?!\s*:)'
    plain = F.transform(F.regexp_extract_all("value", F.lit(literal), F.lit(1)),
                        lambda s: F.replace(s, F.lit("\\/"), F.lit("/")))

    def as_path(s: Column) -> Column:
        local = F.try_url_decode(F.replace(F.substring(s, F.lit(8), F.length(s)), F.lit("+"), F.lit("%2B")))
        p = F.when(s.startswith("file://"), local).otherwise(s)
        return F.when(p.startswith(home), p)

    paths = _bubbles(kv).select("session_id", F.explode(F.array_compact(F.transform(plain, as_path))).alias("path"))
    parts = paths.select("session_id", F.posexplode(F.split("path", "/")).alias("pos", "seg"))
    agree = (
        parts.groupBy("session_id", "pos")
        .agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.count(F.lit(1)).alias("n"))
    )
    # Every path has position 0, so its count is the number of paths.
    total = agree.where(F.col("pos") == 0).select("session_id", F.col("n").alias("total"))
    marked = agree.join(total, "session_id").withColumn("same", (F.col("lo") == F.col("hi")) & (F.col("n") == F.col("total")))
    per = marked.groupBy("session_id").agg(
        F.min(F.when(~F.col("same"), F.col("pos"))).alias("stop"),
        F.array_sort(F.collect_list(F.when(F.col("same"), F.struct("pos", F.col("lo").alias("seg"))))).alias("kept"))
    shared = F.transform(F.filter("kept", lambda k: F.coalesce(k["pos"] < F.col("stop"), F.lit(True))), lambda k: k["seg"])
    # Trailing names with a dot are files, not directories.
    last_dir = F.array_max(F.transform("shared", lambda s, i: F.when(~s.contains("."), i)))
    common = F.array_join(F.slice("shared", 1, F.coalesce("last_dir", F.lit(-1)) + 1), "/")
    rest = F.filter(F.split(F.substring("common", F.lit(len(home) + 1), F.length("common")), "/"), lambda s: s != "")
    picked = F.get("rest", F.when(F.get("rest", F.lit(0)).isin(V.PROJECT_CATEGORY_DIRS), 1).otherwise(0))
    return (
        per.withColumn("shared", shared).withColumn("last_dir", last_dir).withColumn("common", common)
        .where(F.col("common").startswith(home)).withColumn("rest", rest)
        .select("session_id", picked.alias("project")).where(F.col("project").isNotNull())
    )


def parse(kv: DataFrame, developer: str = "", machine: str = "", project: str = "", home: str | None = None) -> DataFrame:
    """(key, value) rows to trace rows. With ``home`` the project of a composer
    comes from its paths, else from the caller."""
    b = F.col("b")
    rows = _bubbles(kv).join(_composers(kv), "session_id")
    own = F.lit(project)
    if home:
        inferred = infer_projects(kv, home).withColumnRenamed("project", "inferred")
        rows = rows.join(inferred, "session_id", "left")
        own = F.coalesce("inferred", F.lit(project))
    tools = J.elements(b, "$.toolFormerData")
    # NULL stands for the bubble itself: it is a message.
    rows = rows.withColumn("tool", F.explode(F.when(F.size(tools) > 0, tools).otherwise(
        F.array(F.lit(None).cast("variant")))))
    t = F.col("tool")
    call = t.isNotNull()
    text = F.coalesce(F.when(J.present(b, "$.text"), J.text(b, "$.text")).otherwise(J.text(b, "$.rawText")), F.lit(""))
    user = J.integer(b, "$.type") == 1
    bubble = J.text(b, "$.bubbleId")
    base = F.concat_ws(":", F.lit("cur"), F.substring("session_id", 1, 8), bubble)
    zero = F.lit(0).cast("bigint")
    spent = F.when(J.present(b, "$.tokenCount.inputTokens"), vendor.usage(
        J.integer(b, "$.tokenCount.inputTokens"), J.integer(b, "$.tokenCount.outputTokens"), zero, zero, zero))
    name = J.text(t, "$.toolName")
    cut = F.substring(text, 1, V.TEXT_CHARS)
    return vendor.finish(rows.where(call | (text != "")).select(
        F.when(call, F.concat_ws(":", base, F.coalesce(name, F.lit("?")))).otherwise(base).alias("id"),
        "timestamp_text", F.lit("cursor").alias("agent"), "session_id",
        F.lit(developer).alias("developer"), F.lit(machine).alias("machine"), own.alias("project"),
        F.when(call, "tool_call").otherwise("message").alias("entry_type"),
        F.when(~call & F.coalesce(user, F.lit(False)), "user").otherwise("assistant").alias("role"),
        "model", spent.alias("usage"),
        F.when(call, vendor.rename(F.coalesce(name, F.lit("unknown")), V.CURSOR_TOOL_NAMES)).alias("tool_name"),
        F.when(call, J.text(t, "$.filePath")).alias("file_path"), F.when(call, J.text(t, "$.command")).alias("command"),
        F.when(~call & F.coalesce(user, F.lit(False)), cut).alias("user_prompt"),
        F.when(~call & ~F.coalesce(user, F.lit(False)), cut).alias("assistant_text"),
    ))
