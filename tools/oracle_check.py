"""Run registered queries beside their SQL in DuckDB and compare whole results.

    python tools/oracle_check.py [--sf 0.01] [--only name,name] [--match prefix]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from deedwork.plans import all_oracles, all_queries
from deedwork.session import TABLES, build_session


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return v + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))


def compare(df, con, sql):
    """(ok, message) for one query against its SQL."""
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rows_of(want_cols, rel.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return False, f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ; cols {sorted(got_cols)}\n   got {bad[0][0]}\n  want {bad[0][1]}"
    return True, f"{len(got)} rows"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--match", default="")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session()
    con = connect(folder)
    oracles = all_oracles()
    only = set(filter(None, args.only.split(",")))
    prefixes = tuple(filter(None, args.match.split(",")))
    failed = []
    n = 0
    for name, fn in all_queries().items():
        if only or prefixes:
            if name not in only and not (prefixes and name.startswith(prefixes)):
                continue
        n += 1
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                ok, msg = compare(df, con, oracles[name])
            else:
                ok, msg = True, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, "".join(traceback.format_exception_only(e))[:700]
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t0:6.2f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{n - len(failed)}/{n} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
