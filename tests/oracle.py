"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(spark_df.columns) != sorted(want_cols):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_cols)}"
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(want_cols, want_rows)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, columns {sorted(want_cols)}\n  got  {bad[0][0]}\n  want {bad[0][1]}"
    types = {"bigint": int, "int": int, "double": float, "string": str, "boolean": bool}
    for c, t in spark_df.dtypes:
        i = want_cols.index(c)
        vals = [r[i] for r in want_rows if r[i] is not None][:50]
        kind = types.get(t)
        if kind and vals and not all(type(v) is kind for v in vals):
            return f"type of {c}: spark {t}, sql {type(vals[0]).__name__}"
    return None
