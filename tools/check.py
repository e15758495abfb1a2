"""Local correctness check: run registered queries in Spark and their oracle
SQL in DuckDB on the same Parquet tables and compare the results.

usage: python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from cartwalk.session import get_spark  # noqa: E402
from cartwalk.plans.registry import load_all, oracle_text  # noqa: E402
from cartwalk.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return str(v) if not isinstance(v, (int, bool, str)) else v


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = get_spark()
    reg = load_all()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf)
            scols = sdf.columns
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(oracle_text(q))
            dcols = [d[0] for d in cur.description]
            drows = [tuple(norm(x) for x in r) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        order = [dcols.index(c) for c in scols]
        drows = [tuple(r[i] for i in order) for r in drows]
        key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r)
        a, b = sorted(srows, key=key), sorted(drows, key=key)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)} diff={diff}")
            bad += 1
        else:
            print(f"ok   {name}: {len(a)} rows ({ts:.1f}s)")
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
