"""Run named queries in Spark and their SQL in DuckDB, and compare rows by value."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(con, spark, fn, sql, sf_dir):
    """None when equal, else a short account of how the two results differ."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(mine)
    if mine == theirs:
        kinds = {d[0]: str(d[1]) for d in cur.description}
        return None, len(mine), {c: (t, kinds[c]) for c, t in df.dtypes}
    extra = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 200000 else []
    lack = [r for r in theirs if r not in set(mine)][:3] if len(theirs) < 200000 else []
    return f"rows {len(mine)} != {len(theirs)}; only spark {extra}; only sql {lack}", len(mine)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = argv[0]
    names = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in oracles:
                got = differences(con, spark, fn, oracles[name], sf)
            else:
                got = (None, len(fn(spark, sf).collect()))
            odd = ""
            if got[0] is None and len(got) > 2:
                pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
                         "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}
                odd = " ".join(f"{c}:{a}/{b}" for c, (a, b) in got[2].items() if pairs.get(a) != b)
            state = "ok  " if got[0] is None else "DIFF"
            if name not in oracles:
                state = "rows"
            bad += state == "DIFF"
            print(f"{state} {name} n={got[1]} {time.time()-t:.1f}s {got[0] or ''} {odd}", flush=True)
        except Exception as error:
            bad += 1
            text = str(error)
            print(f"FAIL {name} {type(error).__name__} {text[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad", bad, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
