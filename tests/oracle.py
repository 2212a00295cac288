"""Compare registered queries with their check SQL in DuckDB.

    python -m tests.oracle /root/testdata/sf0.01 [query …]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as contract
from corpusloom.settings import release_scratch


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = contract.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    expected = _rows(names, want.fetchall())
    sql_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = _rows(df.columns, got)
    if actual == expected:
        return True, f"{len(actual)} rows, {took:.1f}s / sql {sql_took:.1f}s"
    only_a = [r for r in actual if r not in set(expected)][:3]
    only_e = [r for r in expected if r not in set(actual)][:3]
    return False, f"{len(actual)} != {len(expected)} rows\n   spark {only_a}\n   sql   {only_e}"


if __name__ == "__main__":
    where, *wanted = sys.argv[1:]
    spark_, con_ = session(), connect(where)
    spark_.sparkContext.setLogLevel("ERROR")
    bad = []
    for query in wanted or contract.queries():
        try:
            ok, note = compare(spark_, con_, where, query)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not ok:
            bad.append(query)
        print("OK  " if ok else "FAIL", query, note[:3000], flush=True)
    print(len(bad), "failed:", *bad)
    release_scratch(spark_)
