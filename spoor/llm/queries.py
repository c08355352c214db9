"""The operators over the given tables, as registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoor.llm import (contamination, copies, grades, languages, licenses, packing, quality_rules, resampling, sharding, similar,
                       sql, substrings, toxicity, trie)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.query, "op2_quality_rules": quality_rules.query, "op3_substrings": substrings.query,
        "op4_grades": grades.query, "op5_jaccard": similar.query, "op6_toxicity": toxicity.query, "op7_packing": packing.query,
        "op8_sharding": sharding.query, "op9_languages": languages.query, "op10_contamination": contamination.query,
        "op11_trie": trie.query, "op12_copies": copies.query, "op13_resampling": resampling.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
