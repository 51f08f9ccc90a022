"""Run registered queries in Spark and their DuckDB oracles, and compare results.

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_diffs(sdf, rel):
    s_types = dict(sdf.dtypes)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = {}
    for c, t in s_types.items():
        want = SPARK_TO_DUCK.get(t, t)
        got = d_types.get(c)
        if got is not None and got != want:
            out[c] = (t, got)
    return out


def compare(spark, sf_dir, name, fn, sql, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2), note="no oracle")
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
    types = type_diffs(sdf, rel)
    res = dict(name=name, ok=ok_cols and ok_n and ok_v and not types, rows=len(s_rows), oracle_rows=len(d_rows),
               spark_s=round(t1 - t0, 2))
    if types:
        res["types"] = types
    if not ok_cols:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
    elif not ok_v:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["diff"] = diff
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from churnlens.session import get_session
    import __spark_entry__ as E

    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            res = compare(spark, sf_dir, name, fn, oracle.get(name), con)
        except Exception as e:  # noqa: BLE001
            res = dict(name=name, ok=False, error=str(e).splitlines()[0][:300])
        if res.get("ok") is False:
            bad += 1
        print(res, flush=True)
    print(f"FAILED {bad}" if bad else "ALL OK")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
