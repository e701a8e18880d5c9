"""Runs registered queries against their DuckDB SQL: check.py [sf_dir] [name part ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", os.environ.get("CHECK_TZ", "UTC"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from flowlens.session import ship_package

    ship_package(spark)
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return repr(float(v))
    if hasattr(v, "item"):
        v = v.item()
    return "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = query.build(spark, sf_dir)
    got = df.collect()
    took = time.time() - t0
    if query.sql is None:
        return len(got) > 0, f"{name:36s} rows-only {len(got):7d}  {took:6.2f}s"
    res = con.execute(query.sql)
    want_cols, want_types = [c[0] for c in res.description], {c[0]: str(c[1]) for c in res.description}
    want = res.fetchall()
    c1, r1 = rows_of(df.columns, got)
    c2, r2 = rows_of(want_cols, want)
    head = f"{name:36s} {len(r1):7d} / {len(r2):7d}  {took:6.2f}s"
    if c1 != c2:
        return False, f"{head} COLUMNS {set(c1) ^ set(c2)}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(n, types[n], want_types[n]) for n in c1 if kinds.get(types[n]) != want_types[n]]
    if r1 != r2:
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
        only = list((set(r1) - set(r2)))[:2], list((set(r2) - set(r1)))[:2]
        return False, f"{head} VALUES\n   cols {c1}\n   spark only {only[0]}\n   duck only  {only[1]}\n   {diff[:1]}"
    return len(r1) > 0, head + (f"  types {odd}" if odd else "") + ("" if r1 else " EMPTY")


def main() -> int:
    from flowlens.plans import REGISTRY

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con, bad = session(), duck(sf_dir), []
    for name, q in REGISTRY.items():
        if args and not any(a in name for a in args):
            continue
        try:
            ok, text = compare(spark, con, name, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{name:36s} ERROR {type(e).__name__}: {str(e)[:600]}"
        if not ok:
            bad.append(name)
        print(("ok   " if ok else "FAIL ") + text, flush=True)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
