"""Runs a query in Spark and its oracle in DuckDB over one data folder and compares the rows."""

import glob
import math
import os
import sys
import time

import duckdb

DATA = os.environ.get("KVIST_TESTDATA", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, dict):
        return str(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v) if not isinstance(v, bool) else str(v)


def duck(sql, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    r = con.sql(sql)
    return r.columns, r.fetchall()


def compare(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cols, want = duck(sql, folder)
    assert sorted(df.columns) == sorted(cols), (df.columns, cols)
    a = sorted(tuple(norm(r[df.columns.index(c)]) for c in sorted(cols)) for r in got)
    b = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in want)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), bad[:3])
    return len(a)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = sys.path[0]
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master(f"local[{os.environ.get('KVIST_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    q, o = e.queries(), e.oracle_sql()
    for n in names or q:
        t = time.time()
        try:
            if n in o:
                print(n, "rows", compare(s, q[n], o[n], folder), f"{time.time() - t:.1f}s", flush=True)
            else:
                print(n, "rows only", q[n](s, folder).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(n, "BAD", str(x)[:1500], flush=True)
