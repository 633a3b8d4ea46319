"""Runs registered queries next to their SQL twins in DuckDB and compares the rows.

usage: python check.py [--sf DIR] [--group NAME] [query ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from importlib import import_module

import duckdb
import pandas as pd

from fellwalk import plans
from fellwalk.plans.data import TABLES
from fellwalk.session import local_session


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        rows.append(tuple(None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)
                          else (float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else v)
                          for v in r))
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--group")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    if a.group:
        for g in a.group.split(","):
            import_module(f"fellwalk.plans.{g}")
    else:
        plans.load()
    q, o = plans.all_queries(), plans.all_oracles()
    names = a.names or list(q)
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            got = q[n](spark, a.sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark {type(e).__name__} {str(e)[:1200]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if n not in o:
            print(f"rows {n}: {len(got)} rows {t1 - t0:.2f}s (no twin)", flush=True)
            continue
        try:
            exp = con.sql(o[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb {str(e)[:800]}", flush=True)
            bad += 1
            continue
        t2 = time.time()
        if sorted(got.columns) != sorted(exp.columns):
            print(f"FAIL {n}: columns {sorted(got.columns)} != {sorted(exp.columns)}", flush=True)
            bad += 1
            continue
        x, y = normal(got), normal(exp)
        if x != y:
            sx, sy = set(x), set(y)
            print(f"FAIL {n}: {len(x)} vs {len(y)} rows; only spark {len(sx - sy)}, only sql {len(sy - sx)}\n   cols  {sorted(got.columns)}"
                  f"\n   spark {sorted(sx - sy, key=str)[:3]}\n   sql   {sorted(sy - sx, key=str)[:3]}", flush=True)
            bad += 1
        else:
            odd = [c for c in got.columns if str(got[c].dtype) != str(exp[c].dtype)]
            print(f"ok   {n}: {len(x)} rows spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s"
                  + (f" dtypes {[(c, str(got[c].dtype), str(exp[c].dtype)) for c in odd]}" if odd else "")
                  + (" EMPTY" if not len(x) else ""), flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
