"""Run registered queries on Spark and their oracle SQL on DuckDB; compare results.

Usage: python -m tests.oracle_harness [sf_dir] [name ...]
Comparison: same sorted column names, same row count, same multiset of rows after
normalising Python types (ints, floats exact, timestamps, Decimal -> float).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        v = float(v)
        if math.isnan(v):
            return None
        # pandas turns nullable integer columns into float64; compare integral values as int
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, np.datetime64):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    out.sort(key=lambda r: repr(r))
    return cols, out


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "NO_ORACLE"
        return res
    odf = con.execute(sql).df()
    res["oracle_rows"] = len(odf)
    scols, srows = rows_of(sdf)
    ocols, orows = rows_of(odf)
    if scols != ocols:
        res["status"] = "SCHEMA"
        res["detail"] = f"spark={scols} oracle={ocols}"
        return res
    if len(srows) != len(orows):
        res["status"] = "ROWCOUNT"
        return res
    if srows != orows:
        bad = [(a, b) for a, b in zip(srows, orows) if a != b]
        res["status"] = "VALUES"
        res["detail"] = f"{len(bad)} differ; first: spark={bad[0][0]!r} oracle={bad[0][1]!r}"[:600]
        return res
    res["status"] = "OK"
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from alloy.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or sorted(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": "ERROR", "detail": f"{type(e).__name__}: {e}"[:800]}
        if r["status"] not in ("OK", "NO_ORACLE"):
            failed += 1
        print(r, flush=True)
    print(f"FAILED {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
