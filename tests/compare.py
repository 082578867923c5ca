"""Run registered queries next to their SQL twins and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{name}: rows only {len(got)} {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b and a:
        kinds = {n: (str(t), next((type(r[i]).__name__ for r in want if r[i] is not None), None))
                 for i, n in enumerate(names) for t in [df.schema[n].dataType.simpleString()]}
        odd = {n: k for n, k in kinds.items() if (k[0] in ("bigint", "int")) != (k[1] == "int") and k[1]}
        return not odd, f"{name}: ok {len(a)} rows {took:.1f}s {odd or ''}"
    only_a = [r for r in a if r not in set(b)][:3]
    only_b = [r for r in b if r not in set(a)][:3]
    return False, f"{name}: {len(a)} vs {len(b)} rows {sorted(df.columns)}\n  spark {only_a}\n  sql   {only_b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf), E.oracle_sql(), []
    for name, fn in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, line = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:
            ok, line = False, f"{name}: {type(e).__name__} {str(e)[:1200]}"
        print("" if ok else "FAIL ", line, flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failed", bad)
