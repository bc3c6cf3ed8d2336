"""Run a registered query in Spark and its SQL in DuckDB and compare."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from cartlake.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, exact):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v) if exact else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, exact) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, exact)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), exact)
    return v


def rows_of(cols, rows, exact=False):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], exact) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(1 for x, y in zip(a, b) if x != y)} rows): {diff}"
    exact = rows_of(scols, srows, True) == rows_of(dcols, drows, True)
    return True, f"{len(srows)} rows" + ("" if exact else " (float ulp differences)")
