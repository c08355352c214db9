"""The registered queries: smallest scale, a sample of each kind against SQL."""

import re

import check_all
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    fitted = {q for q in entry.queries() if q == "pipeline" or re.match(r"op\d+_", q)}  # have tests of their own
    assert set(entry.queries()) - fitted == set(entry.oracle_sql()) - fitted


@pytest.mark.parametrize("name", [
    "stats", "tool_detail", "session_rollups", "productivity_score", "comparison", "link_commits", "permissions",
    "claude_parse", "redact_documents", "merge_allow_lists", "live_sessions",
])
def test_query_agrees_with_sql(spark, name):
    assert check_all.compare(spark, check_all.connect(SF), name, SF).startswith("ok")


def test_entry(spark):
    df = entry.entry(spark)
    assert "score" in df.columns and df.count() > 0
