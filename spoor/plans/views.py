"""Agent-activity tables derived from the star-schema test tables.

The same text serves two SQL dialects: slots in braces are filled per engine, so
that a query and its cross-check read identical inputs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor import schema as S
from spoor import session
from spoor.operators.security import extract_findings
from spoor.workspace import Workspace

DIALECTS = {
    "spark": {
        "STR": "STRING", "DIV": "DIV", "TS": "timestamp_micros",
        "K": "CAST(get_json_object(props, '$.k') AS BIGINT)",
        "US": "unix_micros(CAST(ts AS TIMESTAMP))",
        "ISO": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")",
        "FILES": "array_sort(collect_list({0}))",
    },
    "duckdb": {
        "STR": "VARCHAR", "DIV": "//", "TS": "make_timestamp",
        "K": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
        "US": "epoch_us(ts)",
        "ISO": "strftime({0}, '%Y-%m-%dT%H:%M:%S')",
        "FILES": "list_sort(list({0}))",
    },
}

EV = "SELECT event_id, user_id, event_type, value, {K} AS k, {US} AS us FROM events"

# Times within a day are compressed 24-fold so that gaps under five minutes occur;
# a session is one user over ten days.
TRACES = """
SELECT concat('ev:', CAST(event_id AS {STR})) AS id,
  {TS}(us - us % 86400000000 + (us % 86400000000 - us % 24) {DIV} 24) AS ts,
  CASE WHEN user_id % 3 = 0 THEN 'claude_code' WHEN user_id % 3 = 1 THEN 'codex' ELSE 'cursor' END AS agent,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat('s', CAST(user_id AS {STR}), '-', CAST(((us - 1704067200000000) {DIV} 864000000000) AS {STR})) END AS session_id,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('p', CAST(user_id % 8 AS {STR})) END AS project,
  concat('dev', CAST(user_id % 5 AS {STR})) AS developer,
  concat('host', CAST(user_id % 7 AS {STR})) AS machine,
  CASE event_type WHEN 'signup' THEN 'message' WHEN 'error' THEN 'tool_result' ELSE 'tool_call' END AS entry_type,
  CASE WHEN event_type = 'signup' AND k % 3 <> 0 THEN 'user' WHEN event_type = 'error' THEN 'tool' ELSE 'assistant' END AS role,
  CASE WHEN k % 5 = 0 THEN NULL ELSE concat('m', CAST(k % 4 AS {STR})) END AS model,
  CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'Read' ELSE 'mcp__db__query' END
    WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'skill:ship' ELSE 'Edit' END ELSE NULL END AS tool_name,
  CASE WHEN event_type IN ('click', 'error') THEN concat('tc', CAST(user_id AS {STR}), '-', CAST(k AS {STR})) ELSE NULL END AS tool_call_id,
  CASE WHEN event_type = 'click' THEN CASE k % 8 WHEN 0 THEN 'git status' WHEN 1 THEN 'LC_ALL=C bun test src/a.ts' WHEN 2 THEN 'bun test'
    WHEN 3 THEN 'grep -rn foo src/' WHEN 4 THEN 'pytest -q' WHEN 5 THEN 'cargo build' WHEN 6 THEN 'X=$(date) ls' ELSE 'ls -la' END ELSE NULL END AS command,
  CASE WHEN event_type IN ('view', 'purchase') THEN concat('/repo/src/f', CAST(k % 20 AS {STR}), CASE WHEN k % 2 = 0 THEN '.ts' ELSE '.py' END) ELSE NULL END AS file_path,
  CASE WHEN event_type = 'signup' AND k % 3 <> 0 THEN CASE k % 4 WHEN 0 THEN '/review this' WHEN 1 THEN '/ship' ELSE 'please fix it, token [REDACTED:github_token]' END ELSE NULL END AS user_prompt,
  CAST(FLOOR(value) AS BIGINT) AS tok_input, k AS tok_output,
  CAST(FLOOR(value) AS BIGINT) * 1000 AS tok_cache_read, k % 7 AS tok_cache_creation,
  CASE WHEN event_type = 'error' THEN k % 2 = 0 ELSE NULL END AS success
FROM ev
"""

# Raw history: no commit has a session. Projects p8..p11 have no sessions.
COMMITS = """
SELECT md5(concat('c', CAST(o_orderkey AS {STR}))) AS commit_sha, us,
  {TS}(us) AS ts,
  concat({LOCAL}, CASE o_custkey % 3 WHEN 0 THEN '-05:00' WHEN 1 THEN '+00:00' ELSE '+05:00' END) AS timestamp_text,
  'commit' AS event_type,
  concat('p', CAST(o_custkey % 12 AS {STR})) AS project, concat('acme/r', CAST(o_custkey % 12 AS {STR})) AS repo,
  'main' AS branch,
  o_orderstatus <> 'F' AS agent_authored,
  CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_custkey % 3 = 0 THEN 'claude_code' WHEN o_custkey % 3 = 1 THEN 'codex' ELSE 'cursor' END AS agent_name,
  n AS files_changed, ins AS insertions, del AS deletions, files,
  concat('Dev ', CAST(o_custkey % 5 AS {STR})) AS author,
  concat('dev', CAST(o_custkey % 5 AS {STR}), '@x.com') AS author_email,
  CASE WHEN o_orderkey % 35 = 0 THEN NULL ELSE concat('change ', CAST(o_orderkey AS {STR})) END AS message,
  CASE WHEN o_orderkey % 10 = 0 THEN concat('/home/dev/r', CAST(o_custkey % 12 AS {STR})) ELSE NULL END AS repo_local,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
    ELSE concat('s', CAST(o_custkey % 150 AS {STR}), '-', CAST(((o_orderkey * 7919) % 43200) {DIV} 14400 AS {STR})) END AS known_session
FROM (SELECT o_orderkey, o_custkey, o_orderstatus,
    1704067200000000 + (((o_orderkey * 7919) % 43200) {DIV} 1440) * 86400000000 + ((o_orderkey * 7919) % 60) * 60000000 AS us
  FROM orders) o
JOIN (SELECT l_orderkey, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS ins,
    CAST(SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS del,
    {FILELIST} AS files
  FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
"""

FILE_NAME = (
    "concat(CASE WHEN l_partkey % 5 = 0 THEN 'tests/t' ELSE 'src/f' END, CAST(l_partkey AS {STR}), "
    "CASE WHEN l_partkey % 7 = 0 THEN '.spec.ts' ELSE '.py' END)"
)


def view_sql(dialect: str) -> dict[str, str]:
    d = DIALECTS[dialect]
    slots = {k: v for k, v in d.items() if "{0}" not in v}
    local = d["ISO"].format(
        f"{d['TS']}(us + CASE o_custkey % 3 WHEN 0 THEN -18000000000 WHEN 1 THEN 0 ELSE 18000000000 END)")
    return {
        "ev": EV.format(**slots),
        "traces": TRACES.format(**slots),
        "commits": COMMITS.format(
            LOCAL=local, FILELIST=d["FILES"].format(FILE_NAME.format(**slots)), **slots),
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Trace rows from the events table, or from a stream of it."""
    sql = view_sql("spark")
    events = table(spark, sf_dir, "events") if events is None else events
    ev = spark.sql(sql["ev"].replace("FROM events", "FROM {events}"), events=events)
    flat = spark.sql(sql["traces"].replace("FROM ev", "FROM {ev}"), ev=ev)
    usage = F.struct(
        F.col("tok_input").alias("input"), F.col("tok_output").alias("output"),
        F.col("tok_cache_read").alias("cache_read"), F.col("tok_cache_creation").alias("cache_creation"),
        F.lit(0).cast("bigint").alias("reasoning"))
    return flat.withColumn("usage", usage)


def commits(spark: SparkSession, sf_dir: str, linked: bool = True) -> DataFrame:
    """Git history; ``linked`` keeps the sessions some commits already have."""
    sql = view_sql("spark")["commits"].replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}")
    rows = spark.sql(sql, orders=table(spark, sf_dir, "orders"), lineitem=table(spark, sf_dir, "lineitem"))
    session = F.col("known_session") if linked else F.lit(None).cast("string")
    return rows.withColumn("session_id", session)


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, sf_dir: str, linked: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans of the three tables. Plans hold no data: building them once per
    session only saves time on the driver."""
    t = S.conform(traces(spark, sf_dir), S.TRACES)
    return t, S.conform(commits(spark, sf_dir, linked), S.GIT_EVENTS), extract_findings(t)


def workspace(spark: SparkSession, sf_dir: str, linked: bool = True, **kw) -> Workspace:
    session.configure(spark)
    t, git, findings = _tables(spark, sf_dir, linked)
    return Workspace(traces=t, git=git, findings=findings, **kw)


def duckdb_views(linked: bool = True) -> str:
    """``WITH`` prelude giving ev, traces and git_events to a DuckDB query."""
    sql = view_sql("duckdb")
    session = "known_session" if linked else "CAST(NULL AS VARCHAR)"
    return (
        f"WITH ev AS ({sql['ev']}), traces AS ({sql['traces']}), commits AS ({sql['commits']}), "
        f"git_events AS (SELECT *, {session} AS session_id FROM commits)"
    )
