"""Run queries against their SQL counterparts in DuckDB and report differences.

usage: python tools/verify.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from assayer.session import local_session  # noqa: E402
from workload import ORACLES, QUERIES  # noqa: E402
from workload.base import TABLES  # noqa: E402


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ", timespec="microseconds")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, db = local_session(int(os.environ.get("VERIFY_CPUS", "8"))), connect(sf_dir)
    bad = []
    for name in names:
        began = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            got = [tuple(r) for r in frame.collect()]
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(exc).splitlines()[0][:300]}", flush=True)
            continue
        took = time.time() - began
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.2f}s", flush=True)
            continue
        try:
            answer = db.execute(ORACLES[name])
            columns, want = [c[0] for c in answer.description], answer.fetchall()
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"SQL   {name}: {str(exc).splitlines()[0][:300]}", flush=True)
            continue
        if sorted(columns) != sorted(frame.columns):
            bad.append(name)
            print(f"DIFF  {name}: columns {sorted(frame.columns)} vs {sorted(columns)}", flush=True)
            continue
        a, b = rows_of(frame.columns, got), rows_of(columns, want)
        if a != b:
            bad.append(name)
            left = [r for r in a if r not in set(b)][:3]
            right = [r for r in b if r not in set(a)][:3]
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows\n   spark {left}\n   duck  {right}", flush=True)
        else:
            print(f"ok    {name}: {len(a)} rows {took:.2f}s", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
