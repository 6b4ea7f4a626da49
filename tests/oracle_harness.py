"""Run a registered query on Spark and its oracle SQL on DuckDB and compare
(row count, column names, order-insensitive values). Used by tests and by hand:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    import datetime as dt
    import numpy as np
    if v is None:
        return None
    if isinstance(v, float) or isinstance(v, np.floating):
        if math.isnan(v):
            return None
        return round(float(v), 6) + 0.0
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    import pandas as pd
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(None if (not isinstance(x, (list, tuple)) and not hasattr(x, "__len__") and pd.isna(x))
                         else _norm(x) for x in rec))
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return cols, sorted(out, key=lambda r: repr(r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(spdf), "spark_s": round(t1 - t0, 2),
           "spark_schema": [(f.name, f.dataType.simpleString()) for f in sdf.schema.fields]}
    if sql is None:
        res["status"] = "rows-only"
        return res
    ddf = con.execute(sql).df()
    res["duck_rows"] = len(ddf)
    res["duck_schema"] = [(c, str(t)) for c, t in zip(ddf.columns, ddf.dtypes)]
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(ddf)
    if sc != dc:
        res["status"] = f"COLUMNS differ {sc} vs {dc}"
    elif len(sr) != len(dr):
        res["status"] = "ROWCOUNT differ"
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        res["status"] = f"VALUES differ ({len(bad)} rows)"
        res["example"] = bad[:3]
    else:
        res["status"] = "ok"
        sd = {c: str(spdf[c].dtype) for c in spdf.columns}
        dd = {c: str(ddf[c].dtype) for c in ddf.columns}
        diff = {c: (sd[c], dd.get(c)) for c in sd if sd[c] != dd.get(c)}
        if diff:
            res["status"] = "ok"
            res["example"] = f"dtype differences {diff}"
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from quarry.session import build_session
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r["name"], r["status"], r.get("spark_rows"), r.get("duck_rows"), r.get("spark_s"),
              r.get("example", ""), flush=True)
        if r["status"].startswith("COLUMNS") or r["status"].startswith("VALUES"):
            print("   spark:", r.get("spark_schema"), "\n   duck:", r.get("duck_schema"))
    print("FAILED", bad)


if __name__ == "__main__":
    main()
