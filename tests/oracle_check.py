"""Compare registered queries with their SQL on one data folder.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else repr(value))
    if value is None:
        return ("null", "")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, int):
        return ("int", str(value))
    return (type(value).__name__, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Row count, and what differs first (None if nothing does)."""
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows, SQL gives {len(want)}"
    for ours, theirs in zip(got, want):
        if ours != theirs:
            return len(got), f"{sorted(names)}\n  spark {ours}\n  sql   {theirs}"
    return len(got), None


def main() -> int:
    from timelens.plans.catalog import QUERIES
    from timelens.plans.oracle import SQL
    from timelens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            n, what = differences(df, con, SQL[name]) if name in SQL else (df.count(), "no SQL, rows only")
        except Exception as failed:  # noqa: BLE001
            n, what = -1, f"{type(failed).__name__}: {str(failed)[:600]}"
        bad += what is not None and name in SQL
        print(f"{'ok ' if what is None else '-- '} {name} rows={n} {time.time() - began:.1f}s {what or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
