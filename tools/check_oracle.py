"""Runs registered queries against their SQL in DuckDB: python tools/check_oracle.py [sf_dir] [name or prefix* ...]"""
from __future__ import annotations

import glob
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def kind(x) -> str:
    t = str(x).lower()
    for k, names in {"int": ("int", "long"), "float": ("float", "double"), "bool": ("bool",)}.items():
        if any(n in t for n in names):
            return k
    return "str"


def compare(got, want) -> str:
    """'' when both frames hold the same rows (any order), else what differs."""
    import pandas as pd
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)

    def canon(df):
        d = pd.DataFrame()
        for c in cols:
            s = df[c]
            if kind(s.dtype) in ("float",):
                d[c] = s.map(lambda x: "" if pd.isna(x) else f"{x + 0.0:.6f}")
            elif kind(s.dtype) == "int":
                d[c] = s.map(lambda x: "" if pd.isna(x) else str(int(x)))
            else:
                d[c] = s.map(lambda x: "" if x is None or (isinstance(x, float) and pd.isna(x)) or x is pd.NA else (f"{x:.6f}" if isinstance(x, float) else str(x)))
        return d.sort_values(cols).reset_index(drop=True)

    g, w = canon(got), canon(want)
    bad = (g != w).any(axis=1)
    if bad.any():
        k = bad.idxmax()
        return f"{int(bad.sum())} rows differ, first: {g.loc[k].to_dict()} != {w.loc[k].to_dict()}"
    kinds = [(c, kind(got[c].dtype), kind(want[c].dtype)) for c in cols if len(got) and kind(got[c].dtype) != kind(want[c].dtype)]
    return f"types {kinds}" if kinds else ""


def main(argv: list[str]) -> int:
    from strataspark.plans import catalogue
    from strataspark.session import local_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    pick = argv[1:]
    spark, con = local_session(), connect(sf)
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if pick and name not in pick and not any(name.startswith(p.rstrip("*")) for p in pick if p.endswith("*")):
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            dt = time.time() - t
            if name in catalogue.ORACLES:
                t2 = time.time()
                msg = compare(got, con.execute(catalogue.ORACLES[name]).df())
                print(f"{'ok  ' if not msg else 'FAIL'} {name} {len(got)} rows {dt:.1f}s sql {time.time() - t2:.1f}s {msg}", flush=True)
                bad += bool(msg)
            else:
                print(f"rows {name} {len(got)} rows {dt:.1f}s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
