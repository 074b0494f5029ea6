"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows.

``python -m lagscope.checks.compare SF_DIR [name,name,...]``
"""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time

FAMILIES = {
    "string": "text", "VARCHAR": "text", "bigint": "int", "int": "int", "BIGINT": "int", "INTEGER": "int",
    "double": "float", "DOUBLE": "float", "boolean": "bool", "BOOLEAN": "bool",
    "timestamp_ntz": "time", "TIMESTAMP": "time", "timestamp": "time",
}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty when both give the same columns, kinds of types and rows; else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    expected = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} <> {sorted(names)}"
    for name, kind in df.dtypes:
        if FAMILIES.get(kind, kind) != FAMILIES.get(kinds[name], kinds[name]):
            return f"type of {name}: {kind} <> {kinds[name]}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"rows {len(got)} <> {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"columns {sorted(names)}\n   spark {a}\n   sql   {b}"
    return ""


def main(sf_dir: str, only: str | None = None) -> int:
    from ..plans.queries import REGISTRY
    from ..session import build_session
    from .oracle import ORACLE

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in only.split(",") if only else REGISTRY:
        started = time.time()
        if name not in ORACLE:
            print(f"----  {name}: no SQL", flush=True)
            continue
        try:
            df = REGISTRY[name](spark, sf_dir)
            problem = compare(df, con, ORACLE[name])
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '}  {name} {time.time() - started:.1f}s {problem}", flush=True)
    print(f"{bad} differ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
