"""Run queries next to their check SQL in DuckDB and compare rows.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb


def normal(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, sf_dir: str, name: str, query, sql: str | None):
    """Mismatch text (empty when equal) and the row count."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "", len(got)
    result = duck(sf_dir).execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    want = rows_of(columns, result.fetchall())
    if got == want:
        return "", len(got)
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"rows {len(got)} != {len(want)}; spark {extra[:2]} duckdb {missing[:2]}", len(got)


def main(argv: list[str]) -> int:
    import __spark_entry__ as contract
    from tidewright.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            problem, n = compare(spark, sf_dir, name, queries[name], oracles.get(name))
        except Exception as exc:  # one broken query must not hide the others
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += bool(problem)
        kind = "ok" if not problem else "BAD"
        weak = "" if name in oracles else " (rows only)"
        print(f"{kind:4}{name:32}{n:8} rows {time.time() - start:6.2f}s{weak} {problem}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
