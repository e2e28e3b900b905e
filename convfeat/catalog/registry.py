"""Named queries over the test tables, each with the SQL it must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convfeat.functions.arrays import mapped

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# ---- lists and rounded numbers as text, the same in both engines ----------------


def ids_text(ids: str) -> Column:
    return F.expr(f"array_join({mapped(ids, lambda x: f'string({x})')}, ',')")


def vec_text(vector: str, scale: int = 1_000_000) -> Column:
    return ids_text(mapped(vector, lambda x: f"bigint(floor({x} * double({scale}) + 0.5D))"))


def rounded(x: Column, scale: int = 1_000_000) -> Column:
    return F.floor(x * float(scale) + 0.5) / float(scale)


def sql_ids(e: str) -> str:
    return f"array_to_string({e}, ',')"


def sql_vec(e: str, scale: int = 1_000_000) -> str:
    return sql_ids(f"list_transform({e}, lambda x: floor(x * {scale}::double + 0.5::double)::bigint)")


def sql_rounded(e: str, scale: int = 1_000_000) -> str:
    return f"floor(({e}) * {scale}::double + 0.5::double) / {scale}::double"
