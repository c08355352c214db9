"""Exact copies: grouped by a 128-bit hash of their content, told apart by their bytes.

Only hashes and ids are grouped for all rows. Texts that share a hash are then compared
byte by byte: rows that can be in such a group (a filter of fixed size tells) are grouped
by hash and text, which combines the copies of a hot group in the tasks that read them, so
one text per task is moved. Hashes with more than one text are collisions; their rows are
grouped by their texts alone. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import bits, common


def content(text: str, lower: bool = True) -> Column:
    """The bytes that are compared: UTF-8, A-Z lower-cased if asked; null counts as empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (F.translate(whole, common.UPPER, common.LOWER) if lower else whole).cast("binary")


def digest_128(raw: Column) -> Column:
    """The first 128 bits of the SHA-256 of ``raw``."""
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, 16)


def _best(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    """Per group: keep_id, keep_row (the row that stays; rows of one id are equal) and n."""
    least, at = {"smallest": (F.min, F.min_by), "largest": (F.max, F.max_by)}[keep]
    return rows.groupBy(*by).agg(
        least("id").alias("keep_id"), F.coalesce(at("row", "id"), F.min("row")).alias("keep_row"), F.count(F.lit(1)).alias("n"))


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = True, keep: str = "smallest",
         digest: Callable[[Column], Column] = digest_128) -> DataFrame:
    """One row per row of ``docs``: id, sha (SHA-256 of the content), keep_id, group_size, kept.

    Of rows with equal content the one with the ``keep`` ('smallest' or 'largest') id stays;
    of several rows with that id one; a null id loses to any other. Null texts are empty
    texts, which are copies of each other. Other columns are not read, whatever their names.
    An empty table gives no rows. ``digest`` may be weak: results stay the same.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    source = docs.select(F.col(key).alias("id"), content(text, lower).alias("raw")).withColumn("digest", digest(F.col("raw")))
    rows = common.stage(source.select("id", "digest", F.unhex(F.sha2("raw", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")
    groups = common.stage(_best(rows, ["digest"], keep).where("n > 1"), "groups")
    near = bits.passing(source.select("digest", "raw"), "digest", bits.maps(groups, "digest"))
    texts = near.groupBy("digest", "raw").agg(F.count(F.lit(1)).alias("n"))
    clash = common.stage(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clash")
    if not clash.limit(1).count():
        return _marked(rows, groups, ["digest"])
    apart = source.join(clash, "digest", "left_semi").withColumn("sha", F.unhex(F.sha2("raw", 256)))
    apart = common.stage(apart.withColumn("row", F.monotonically_increasing_id()), "apart")
    own = _best(apart, ["digest", "raw"], keep).where("n > 1")
    return _marked(rows.join(clash, "digest", "left_anti"), groups, ["digest"]).union(_marked(apart, own, ["digest", "raw"]))


def _marked(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    alone = F.col("n").isNull()
    return rows.join(groups, by, "left").select(
        "id", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = True, **how) -> DataFrame:
    """``docs`` without the copies that ``mark`` drops, with all its columns, whose names may
    be any. A dropped row is found again by its id and the SHA-256 of its content; rows that
    share both with the row that stays leave one of them."""
    marks = common.stage(mark(docs, key, text, lower, **how), "marks")
    sha, one = bits.free(docs.columns, "sha", "one")
    narrow = marks.select(F.col("id").alias(one), F.col("sha").alias(sha), "kept")
    gone = common.stage(narrow.groupBy(one, sha).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 or not kept"), "gone")
    rows = docs.withColumn(sha, F.unhex(F.sha2(content(text, lower), 256)))
    same = F.col(key).eqNullSafe(F.col(one)) & (rows[sha] == gone[sha])
    out = rows.join(gone, same, "left_anti").drop(sha)
    again = gone.where("kept")
    if again.limit(1).count():
        held = rows.join(again, F.col(key).eqNullSafe(F.col(one)) & (rows[sha] == again[sha]), "left_semi")
        out = out.union(held.dropDuplicates([key, sha]).drop(sha))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark(common.table(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
