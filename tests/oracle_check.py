"""Run registered queries in Spark and their DuckDB oracle; compare rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's check: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "asDict"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    ts = time.time() - t0
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_sec=round(ts, 2))
    t0 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    td = time.time() - t0
    out = dict(name=name, rows=len(srows), oracle_rows=len(drows), spark_sec=round(ts, 2), duck_sec=round(td, 2))
    if sorted(scols) != sorted(dcols):
        out.update(ok=False, why=f"columns {scols} vs {dcols}")
        return out
    idx = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in idx) for r in drows]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    if a == b:
        out["ok"] = True
    else:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out.update(ok=False, why=f"value mismatch e.g. {diffs}")
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from quillrank.plans import load_all
    from quillrank.session import get_spark
    reg = load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, fn in reg.QUERIES.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, reg.ORACLE.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
