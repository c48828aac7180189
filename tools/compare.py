"""Run registered queries beside their SQL on one folder and report any difference.

Usage: python tools/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stopscan.plans import load  # noqa: E402
from stopscan.session import build_session  # noqa: E402


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (
                isinstance(v, float) and np.isnan(v)) else v)
    keyed = df.astype(str)
    order = keyed.sort_values(list(df.columns), kind="mergesort").index
    return df.loc[order].reset_index(drop=True)


def kind(series: pd.Series) -> str:
    if series.dtype == object:
        found = {type(v).__name__ for v in series.dropna().head(50)}
        return ",".join(sorted(found))
    return series.dtype.kind


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    notes = []
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not bool(same.all()):
            at = np.flatnonzero(~same.to_numpy())[0]
            notes.append(f"{c}: {int((~same).sum())} differ, first {x[at]!r} vs {y[at]!r}")
        elif kind(x) != kind(y) and not x.isna().any():
            notes.append(f"{c}: kind {kind(x)} vs {kind(y)}")
    return "; ".join(notes)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    spark = build_session("compare", cores=8, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{arguments.sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries, oracles = load()
    names = [n for n in queries if not arguments.names
             or any(n == w or (w.endswith("*") and n.startswith(w[:-1]))
                    for w in arguments.names)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            mine = queries[name](spark, arguments.sf).toPandas()
            spent = time.time() - start
            if name not in oracles:
                print(f"rows   {name:34s} {len(mine):7d} rows {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            theirs = con.execute(oracles[name]).df()
            oracle_s = time.time() - start
            note = difference(mine, theirs)
        except Exception as error:
            note = str(error).split("JVM stacktrace")[0][:900] or traceback.format_exc()[-500:]
            mine, oracle_s = [], 0.0
            spent = time.time() - start
        failed += bool(note)
        print(f"{'FAIL ' if note else 'ok   '}  {name:34s} {len(mine):7d} rows {spent:6.1f}s "
              f"sql {oracle_s:5.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
