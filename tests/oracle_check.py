"""Run every registered query and its DuckDB oracle side by side (row count, columns, values).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    t1 = time.time()
    scols = sdf.columns
    out = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = duckdb.connect()
    con.execute(f"SET TimeZone='{os.environ.get('ORACLE_TZ', 'UTC')}'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    out["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        out["status"] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        return out
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    s = sorted((tuple(_norm(r[i]) for i in order) for r in srows), key=_key)
    d = sorted((tuple(_norm(r[i]) for i in dorder) for r in drows), key=_key)
    if s == d:
        out["status"] = "ok"
    else:
        sset, dset = set(map(repr, s)), set(map(repr, d))
        out["status"] = "VALUES"
        out["only_spark"] = sorted(sset - dset)[:3]
        out["only_oracle"] = sorted(dset - sset)[:3]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from runready.session import get_spark
    spark = get_spark("local[8]", 8)
    qs, oc = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and name not in names:
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], oc.get(name))
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
