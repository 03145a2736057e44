"""Strict comparison of a registered query with its SQL: names, types, rows and exact values."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and v != v:
        return "NaN"
    return v


def compare(spark, con, run, sql: str, sf_dir: str) -> list[str]:
    """Differences found; empty when the results agree."""
    df = run(spark, sf_dir)
    rel = con.execute(sql)
    theirs_cols = [(d[0], str(d[1])) for d in rel.description]
    theirs = rel.fetchall()
    names = sorted(df.columns)
    problems = []
    if names != sorted(c for c, _ in theirs_cols):
        return [f"columns {names} vs {sorted(c for c, _ in theirs_cols)}"]
    kinds = dict(theirs_cols)
    for name, kind in df.dtypes:
        want = TYPES.get(kind, kind.upper())
        if want != kinds[name].replace(" ", ""):
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    order = [c for c, _ in theirs_cols]
    ours = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    other = [tuple(_plain(row[order.index(c)]) for c in names) for row in theirs]
    if len(ours) != len(other):
        problems.append(f"rows {len(ours)} vs {len(other)}")
    a, b = sorted(ours, key=repr), sorted(other, key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ; columns {names}; first {bad[0][0]} vs {bad[0][1]}")
    if not ours:
        problems.append("empty result")
    return problems
