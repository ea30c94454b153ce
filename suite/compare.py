"""Run queries on Spark and their SQL on DuckDB, and compare the rows.

    python -m suite.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cores: str = "8", name: str = "suite") -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def sorted_rows(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def difference(
    df: DataFrame, con: duckdb.DuckDBPyConnection, statement: str
) -> tuple[int, str | None]:
    """Row count, and a description of the first difference or None."""
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(statement)
    names = [d[0] for d in con.description]
    want = sorted_rows(names, con.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows against {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return len(got), f"\n  spark {mine[:900]}\n  sql   {theirs[:900]}"
    return len(got), None


def main(arguments: list[str]) -> int:
    from suite.oracles import ORACLES, sql
    from suite.queries import QUERIES

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:] or list(QUERIES)
    spark, con, bad = local_session(), database(folder), 0
    for name in chosen:
        start = time.time()
        df = QUERIES[name](spark, folder)
        if name in ORACLES:
            count, found = difference(df, con, sql(ORACLES[name]))
        else:
            count, found = len(df.collect()), None
        bad += found is not None
        verdict = "DIFFERS " + found if found else ("ok" if name in ORACLES else "rows only")
        print(f"{name:32s} {count:8d} rows {time.time() - start:6.2f}s {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
