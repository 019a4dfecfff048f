"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's gate: same row count, same column names, and the same
order-insensitive multiset of rows (columns sorted by name).

    python scripts/check_oracles.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pagemill.plans import ORACLES, QUERIES  # noqa: E402
from pagemill.session import get_spark  # noqa: E402
from pagemill.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(norm(r[i]) for i in order) for r in rows]


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name, fn in QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception:
            print(f"FAIL {name}: spark error\n{traceback.format_exc()[-2500:]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"ROWS {name}: {len(srows)} rows ({t1 - t0:.1f}s)")
            continue
        try:
            res = con.execute(ORACLES[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:
            print(f"FAIL {name}: duckdb error {str(e)[:1500]}")
            bad += 1
            continue
        msg = []
        if sorted(scols) != sorted(dcols):
            msg.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            msg.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not msg:
            a = sorted(rows_of(scols, srows), key=repr)
            b = sorted(rows_of(dcols, drows), key=repr)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                sa, sb = set(a), set(b)
                msg.append(f"values differ; spark-only={list(sa - sb)[:2]} duck-only={list(sb - sa)[:2]} first={diff[:1]}")
        if msg:
            bad += 1
            print(f"FAIL {name}: " + " | ".join(m[:1500] for m in msg))
        else:
            ok += 1
            print(f"OK   {name}: {len(srows)} rows ({t1 - t0:.1f}s)")
    print(f"== {ok} ok, {bad} failed")


if __name__ == "__main__":
    main()
