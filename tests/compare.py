"""Run catalogue queries against their SQL: ``python tests/compare.py sf_dir [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else value
    return str(value)


def canonical(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    ours = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = canonical(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        only = [r for r in ours if r not in set(theirs)][:2], [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} and {len(theirs)} rows; {str(only)[:1500]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ; {str(wrong[0])[:1500]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from webloom.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": 8,
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if name not in sqls or names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, sqls[name])
            rows = con.execute(f"select count(*) from ({sqls[name]})").fetchone()[0] if not problem else "?"
        except Exception as error:  # report and go on with the next one
            problem, rows = f"{type(error).__name__}: {str(error)[:1200]}", "?"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += problem is not None
        print(f"{name:24s} {'ok' if problem is None else 'FAIL'} {rows} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
