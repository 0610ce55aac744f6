"""Run registered queries beside their DuckDB SQL: ``python tests/compare.py [sf] [query ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in values)


def compare(spark, con, sf_dir: str, run, sql: str | None) -> tuple[int, str | None]:
    """Row count, and what differs (None if nothing does)."""
    frame = run(spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    if sql is None:
        return len(got[1]), None
    answer = con.execute(sql)
    want = rows([c[0] for c in answer.description], answer.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} but {want[0]}"
    if got[1] != want[1]:
        mine, theirs = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return len(got[1]), (
            f"{len(got[1])} rows but {len(want[1])}; only here {sorted(mine)[:3]}, "
            f"only in SQL {sorted(theirs)[:3]}"
        )
    return len(got[1]), None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{scale}"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    sqls, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            count, problem = compare(session, connection, folder, run, sqls.get(name))
        except Exception as e:
            count, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        state = "rows only" if name not in sqls else "ok"
        print(f"{name:24} {count:8} {time.time() - began:6.1f}s {problem or state}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
