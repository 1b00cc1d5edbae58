"""Runs registered queries next to their SQL in DuckDB and compares every value.

    python tests/check_queries.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype) in ("Int32", "Int64", "int32", "int64", "boolean", "bool"):
            df = df.assign(**{c: df[c].astype(float)})
        elif df[c].dtype == object and df[c].map(lambda v: isinstance(v, bool) or v is None).all():
            df = df.assign(**{c: df[c].astype(float)})
    keys = [c for c in df.columns if df[c].dtype == object or str(df[c].dtype).startswith("str")]
    rest = [c for c in df.columns if c not in keys]
    return df.sort_values(keys + rest, kind="stable").reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> list[str]:
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(set(a.columns) ^ set(b.columns))}"]
    if len(a) != len(b):
        return [f"rows {len(a)} vs {len(b)}"]
    a, b = canonical(a), canonical(b)
    out = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == float and y.dtype == float:
            bad = ~((x == y) | (x.isna() & y.isna()))
            if bad.any():
                gap = (x - y).abs()[bad].max()
                out.append(f"{c}: {int(bad.sum())} values, max gap {gap}, nulls {x.isna().sum()}/{y.isna().sum()}, e.g. {x[bad].iloc[0]} vs {y[bad].iloc[0]}")
        else:
            bad = ~((x == y) | (x.isna() & y.isna()))
            if bad.any():
                out.append(f"{c}: {int(bad.sum())} differ ({x.dtype}/{y.dtype}), e.g. {x[bad].iloc[0]!r} vs {y[bad].iloc[0]!r}")
    return out


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="0.01")
    args = p.parse_args()
    import __spark_entry__ as entry
    from tickloom.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    con, failed = connect(sf_dir), 0
    names = args.names or list(queries)
    if args.names and args.names[0].endswith("*"):
        names = [n for n in queries if n.startswith(args.names[0][:-1])]
    for name in names:
        t0 = time.time()
        try:
            mine = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"rows  {name} rows={len(mine)} spark={t1 - t0:.1f}s", flush=True)
                continue
            diff = differences(mine, con.execute(oracles[name]).df())
            state = "ok   " if not diff else "BAD  "
            failed += bool(diff)
            print(f"{state} {name} rows={len(mine)} cols={mine.shape[1]} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s", *diff[:6], sep="\n      " if diff else " ", flush=True)
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
