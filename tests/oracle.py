"""Run registered queries on Spark and their SQL on DuckDB over the same parquet files and compare the rows.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat() if value.tzinfo else value.isoformat()
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str:
    started = time.time()
    frame = fn(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    took = time.time() - started
    if sql is None:
        return f"rows  {name}: {len(got)} rows in {took:.1f}s"
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    sql_took = time.time() - started
    if sorted(names) != sorted(frame.columns):
        return f"FAIL  {name}: columns {sorted(frame.columns)} != {sorted(names)}"
    if got != want:
        mine, theirs = set(map(repr, got)), set(map(repr, want))
        return (f"FAIL  {name}: {len(got)} vs {len(want)} rows; only spark {sorted(mine - theirs)[:3]}; "
                f"only sql {sorted(theirs - mine)[:3]}")
    kinds = {d[0]: str(d[1]) for d in result.description}
    return f"ok    {name}: {len(got)} rows, spark {took:.1f}s, sql {sql_took:.1f}s  {_types(frame, kinds)}"


# DuckDB type -> Spark types that hold the same values
SAME = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "TIMESTAMP": "timestamp_ntz"}


def _types(frame, kinds: dict[str, str]) -> str:
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in frame.dtypes if kinds[n] in SAME and SAME[kinds[n]] != t
           or kinds[n] not in SAME and "[" not in kinds[n] and "(" not in kinds[n]]
    return f"(types {odd})" if odd else ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from attest.session import build_session
    from __spark_entry__ import oracle_sql, queries

    QUERIES, ORACLES = queries(), oracle_sql()
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        try:
            line = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as exc:
            line = f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:600]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
