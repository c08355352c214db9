"""The corpus pipeline: five stages over ``documents``, each applied to all that the one
before kept. What a stage returns is written as a table and read again by the next.

All but the last return the columns of ``documents``; ``n_chars`` follows changed texts. Tables
that a stage made for itself go when the next one begins: by then its result is written.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import common, contamination, packing, similar, substrings, toxicity
from spoor.plans import lake

_left: list[str] = []


def _clearing(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for folder in _left:
            lake.delete(spark, folder)
        _left.clear()
        with common.noted() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


@_clearing
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


@_clearing
def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays. Words are those of
    ``op5_jaccard``: A-Z count as a-z."""
    return similar.keep_one(docs, lower=True)


@_clearing
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are cut from later documents; emptied ones go."""
    return _counted(substrings.clean(docs))


@_clearing
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    return _counted(contamination.clean(docs, common.table(spark, sf_dir, "benchmark")))


@_clearing
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left, packed into sequences."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("jaccard_join", keep_one_of_similar), ("substring_dedup", cut_repeats),
          ("decontamination", cut_benchmark), ("packing", pack)]

#: The first stage fits a model, the last one packs: neither is SQL. tests/llm/ hold every
#: stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
