"""Run registered queries in Spark and their SQL twins in DuckDB; compare results.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Mirrors the driver's check: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from gradeframe.plans.views import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 1e15:
            return float(v)
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name in (names or sorted(qs)):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        t1 = time.time()
        if name not in os_:
            if verbose:
                print(f"{name:28s} rows={len(rows):7d} (no oracle) spark={t1-t0:.2f}s")
            continue
        res = con.execute(os_[name])
        dcols = [d[0] for d in res.description]
        drows = res.fetchall()
        c1, r1 = canon(cols, rows)
        c2, r2 = canon(dcols, drows)
        ok = c1 == c2 and r1 == r2
        if verbose:
            print(f"{name:28s} rows={len(rows):7d}/{len(drows):7d} {'OK ' if ok else 'BAD'} spark={t1-t0:.2f}s")
        if not ok:
            bad.append(name)
            if c1 != c2:
                print("   cols spark:", c1, "\n   cols duck: ", c2)
            else:
                s1, s2 = set(r1), set(r2)
                print("   only spark:", list(s1 - s2)[:3])
                print("   only duck: ", list(s2 - s1)[:3])
    return bad


if __name__ == "__main__":
    from gradeframe.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]")
    bad = compare(spark, sf, sys.argv[2:] or None)
    print("MISMATCH:", bad)
