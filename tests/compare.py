"""Run a query in Spark and its SQL in DuckDB and report the differences."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([_plain(r[i]) for i in order]) for r in rows)), [names[i] for i in order]


def differences(spark_df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    want_names = [c[0] for c in cursor.description]
    want_types = dict(zip(want_names, [str(c[1]) for c in cursor.description], strict=True))
    want, want_cols = _rows(want_names, cursor.fetchall())
    got, got_cols = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    out = [
        f"type of {n}: {t} vs {want_types[n]}" for n, t in spark_df.dtypes if kinds.get(t, t) != want_types[n]
    ]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only = set(got) - set(want), set(want) - set(got)
        out.append(f"{len(only[0])} only in Spark, {len(only[1])} only in SQL")
        out += [f"  spark {r[:400]}" for r in sorted(only[0])[:2]] + [f"  sql   {r[:400]}" for r in sorted(only[1])[:2]]
    return out
