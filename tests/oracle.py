"""Compare registered queries with their SQL on one scale folder: `python tests/oracle.py <sf_dir> [name-prefix…]`."""

from __future__ import annotations

import glob
import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else v
    if hasattr(v, "item"):
        return norm(v.item())
    return v if isinstance(v, (int, str)) else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf) -> str:
    t = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(rows)} rows {took:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, b = rows_of(df.columns, rows), rows_of(cols, want)
    if a[0] != b[0]:
        return f"FAIL columns {a[0]} != {b[0]}"
    if a[1] == b[1]:
        return f"ok {len(rows)} rows {took:.1f}s"
    if len(a[1]) != len(b[1]):
        return f"FAIL rows {len(a[1])} != {len(b[1])}"
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"FAIL {len(diff)} differ, e.g. {a[0]}\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"


def main() -> None:
    from tidemark.plans.registry import ORACLES, QUERIES
    from tidemark.session import local_session

    sf, picks = sys.argv[1], sys.argv[2:]
    mods = [p[4:] for p in picks if p.startswith("mod:")]
    picks = [p for p in picks if not p.startswith("mod:")]
    if mods:
        for m in mods:
            importlib.import_module(f"tidemark.plans.{m}")
    else:
        importlib.import_module("tidemark.plans").load()
    spark = local_session()
    con = connect(sf)
    bad = 0
    for name, fn in list(QUERIES.items()):
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            result = compare(spark, con, name, fn, ORACLES.get(name), sf)
        except Exception as e:  # noqa: BLE001  (report and go on)
            result = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name}: {result}", flush=True)
    print(f"checked, {bad} bad")
    sys.stdout.flush()


if __name__ == "__main__":
    main()
