"""Compares the registered queries with their DuckDB SQL, as the driver does: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(rows: list, names: list[str]) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(repr(float(r[i]) if isinstance(r[i], float) else r[i]) for i in order) for r in rows]
    return sorted(out)


def difference(spark, con, sf_dir: str, f, sql: str) -> str:
    """Empty if the query's rows are the SQL's."""
    df = f(spark, sf_dir)
    mine = normal([tuple(r) for r in df.collect()], df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    theirs = normal(got.fetchall(), names)
    if mine == theirs:
        return ""
    off = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    return f"{len(mine)} rows, {len(theirs)} in SQL; {len(off)} differ, first {off[:1]}"


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, only = sys.argv[1], sys.argv[2:]
    con, oracles = connect(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if only and name not in only or not only and name not in oracles:
            continue
        began = time.time()
        try:
            said = difference(spark, con, sf_dir, f, oracles[name]) if name in oracles else f"{f(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # each query is told about
            said = f"{type(e).__name__} {str(e)[:300]}"
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
