"""Run every registered query on Spark and its oracle SQL on DuckDB and
compare row count, column names and an order-insensitive value hash.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "\x00null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from gatewatch.session import build_session

    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .getOrCreate())
    else:
        spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = sqls.get(name)
        if sql is None:
            print(f"NOSQL {name}: rows={len(s_rows)} {ts:.2f}s")
            continue
        try:
            cur = con.execute(sql)
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        ok_h = ok_cols and digest(s_cols, s_rows) == digest(d_cols, d_rows)
        status = "OK  " if (ok_cols and ok_n and ok_h) else "FAIL"
        if status != "OK  ":
            bad += 1
        print(f"{status} {name}: rows spark={len(s_rows)} duck={len(d_rows)} cols={ok_cols} hash={ok_h} {ts:.2f}s")
        if status != "OK  " and ok_cols:
            order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
            dorder = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
            ss = sorted("|".join(_norm(r[i]) for i in order) for r in s_rows)
            dd = sorted("|".join(_norm(r[i]) for i in dorder) for r in d_rows)
            sset, dset = set(ss), set(dd)
            print("   spark-only:", [x for x in ss if x not in dset][:3])
            print("   duck-only: ", [x for x in dd if x not in sset][:3])
        elif not ok_cols:
            print("   spark cols:", s_cols, "\n   duck cols: ", d_cols)
    print(f"done, {bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
