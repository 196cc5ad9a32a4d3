"""Runs queries beside their DuckDB twins: ``python tests/compare.py [--sf sf0.01] NAME...``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, Decimal):
        return plain(float(x))
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def compare(spark, name: str, query, sql: str | None, sf_dir: str) -> str:
    """"" if both agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    if sql is None:
        return ""
    columns, found = oracle(sql, sf_dir)
    theirs = rows(columns, found)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        only = [x for x in mine if x not in set(theirs)][:2], [x for x in theirs if x not in set(mine)][:2]
        return f"{len(mine)} and {len(theirs)} rows; only one side has {only}"
    return ""


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("docstrata").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as e

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    known, sql = e.queries(), e.oracle_sql()
    for name in args or known:
        t = time.time()
        try:
            said = compare(spark, name, known[name], sql.get(name), f"{DATA}/{sf}")
        except Exception as x:  # shown, and the next query runs
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{name}: {'ok' if not said else said} ({'oracle' if name in sql else 'rows only'}, {time.time() - t:.1f} s)", flush=True)
