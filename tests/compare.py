"""Compare registered queries with their SQL checks."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.17g}" if abs(v) < 2**53 else str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        out.append(tuple(f"{float(r[i]):.9g}" if isinstance(r[i], (int, float)) and not isinstance(r[i], bool)
                         else _cell(r[i]) for i in order))
    return sorted(out)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) of one query against its check."""
    t0 = time.time()
    df = query(spark, sf_dir)
    table = df.toArrow()
    got = rows_of(df.columns, zip(*[c.to_pylist() for c in table.columns]) if table.num_columns else [])
    t1 = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    t2 = time.time()
    timing = f"spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s rows {len(got)}"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)} {timing}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} vs {len(want)}; extra {extra} missing {lack} {timing}"
    return True, timing
