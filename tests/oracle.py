"""Compare a query with its SQL: ``python -m tests.oracle <sf_dir> [query ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(lines, key=lambda line: tuple((x is None, str(x)) for x in line))


def spark_table(df):
    return table_of(df.columns, [tuple(row) for row in df.collect()])


def sql_table(con, sql):
    result = con.execute(sql)
    return table_of([d[0] for d in result.description], result.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows / {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(wrong)} of {len(got[1])} rows differ, first: {wrong[0]}" if wrong else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from convfeat.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = spark_table(df)
            took = time.time() - start
            verdict = "rows only" if name not in sqls else difference(got, sql_table(con, sqls[name])) or "equal"
            types = [f"{n}:{t}" for n, t in df.dtypes if t not in ("bigint", "string", "double", "int")]
            print(f"{name:20s} {took:6.2f}s {len(got[1]):7d} {verdict[:600]} {types or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:20s} FAILED {type(error).__name__}: {str(error)[:900]}", flush=True)


if __name__ == "__main__":
    main()
