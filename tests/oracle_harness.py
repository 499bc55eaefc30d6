"""Local stand-in for the driver's correctness gate.

Runs each catalogue query on Spark and its oracle SQL on DuckDB over the
same parquet files; compares column names, row counts and sorted values.
Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, f"{round(v, 6):.6f}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return (2, repr([_norm(x) for x in v]))
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, int):
        return (1, f"{float(v):.6f}")
    return (3, str(v))


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out)


SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP",
                 "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def type_diff(sdf, desc):
    s = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in sdf.schema.fields}
    d = {x[0]: str(x[1]) for x in desc}
    return {k: (s[k], d.get(k)) for k in s if s[k] != d.get(k)}


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    ts = time.time() - t
    if sql is None:
        return dict(name=name, status="rows-only", rows=len(s_rows), sec=round(ts, 2))
    d = con.execute(sql)
    d_cols = [x[0] for x in d.description]
    d_rows = d.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return dict(name=name, status="COLS", spark=s_cols, duck=d_cols)
    td = type_diff(sdf, d.description)
    if td:
        return dict(name=name, status="TYPES", diff=td)
    if len(s_rows) != len(d_rows):
        return dict(name=name, status="ROWS", spark=len(s_rows), duck=len(d_rows))
    a, b = canon(s_rows, s_cols), canon(d_rows, d_cols)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return dict(name=name, status="VALUES", first=bad)
    return dict(name=name, status="ok", rows=len(s_rows), sec=round(ts, 2))


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from sparkwright.plans.catalog import REGISTRY
    from sparkwright.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, status="ERROR", err=f"{type(e).__name__}: {str(e)[:600]}")
            traceback.print_exc(limit=2)
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
