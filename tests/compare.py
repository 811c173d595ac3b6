"""Registered queries against their SQL: python tests/compare.py [sf] [names]. Rows are compared as sorted lists."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _plain(x: object) -> object:
    return round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows and column names are equal."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, got = rows(names, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    if want != got:
        first = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
        return f"{len(got)} rows, not {len(want)}; first difference {first}"
    return ""


def session() -> SparkSession:
    conf = {"spark.master": os.environ.get("COMPARE_MASTER", "local[8]"), "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.config(map=conf).getOrCreate()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir, only = f"{DATA}/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}", sys.argv[2:]
    spark, con, sql = session(), connection(sf_dir), entry.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, f in entry.queries().items():
        if (only and name not in only) or (not only and name not in sql):
            continue
        began = time.time()
        try:
            said = difference(f(spark, sf_dir), con, sql[name]) if name in sql else f"{f(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(said) and name in sql
        print(f"{name}: {said[:700] or 'ok'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} differ")
    sys.exit(bool(bad))
