"""Compare every registered query with its SQL, at one scale."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from spoor import session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(rows: list[tuple], cols: list[str], order: list[str]) -> list[tuple]:
    idx = [cols.index(c) for c in order]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.5f}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in idx) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows only ({len(got)})"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(cols)}"
    order = sorted(cols)
    a, b = _norm(got, df.columns, order), _norm(want, cols, order)
    if a == b:
        return f"ok {len(a)}"
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
    return f"DIFF spark={len(a)} sql={len(b)} cols={order}\n   spark only: {only_a}\n   sql only:   {only_b}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session.local()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in entry.queries():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            res = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on
            res = "FAIL " + str(e)[:900]
        bad += not res.startswith(("ok", "rows"))
        print(f"{name}: {res} [{time.time() - t:.1f}s]", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
