"""Compare each registered query with its DuckDB oracle (row count, column
names, order-insensitive values). Run: python -m tests.oracle_harness [keys...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, keys=None, sf_dir="/root/testdata/sf0.01", verbose=True):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in keys or list(qs):
        t0 = time.time()
        try:
            sp = qs[k](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            results[k] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(k, results[k], flush=True)
            continue
        t1 = time.time()
        if k not in sqls:
            results[k] = f"rows-only {len(sp)}"
            print(f"{k:28s} {results[k]}  spark {t1-t0:.1f}s", flush=True)
            continue
        try:
            dk = con.execute(sqls[k]).df()
        except Exception as e:  # noqa: BLE001
            results[k] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(k, results[k], flush=True)
            continue
        t2 = time.time()
        ok_cols = sorted(sp.columns) == sorted(dk.columns)
        ok_n = len(sp) == len(dk)
        ok_v = ok_cols and ok_n and canon(sp) == canon(dk)
        results[k] = "OK" if ok_v else f"MISMATCH cols={ok_cols} n={len(sp)}/{len(dk)}"
        print(f"{k:28s} {results[k]}  spark {t1-t0:.1f}s duck {t2-t1:.1f}s", flush=True)
        if not ok_v and verbose:
            if not ok_cols:
                print("   spark cols", sorted(sp.columns), "\n   duck cols ", sorted(dk.columns))
            else:
                a, b = canon(sp), canon(dk)
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:3])
                print("   only duck: ", list(sb - sa)[:3])
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from corpuslab.session import get_session
    spark = get_session()
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    res = compare(spark, args or None, sf)
    bad = [k for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))]
    print("FAILED:", bad)
