"""Joining ids to their vectors.

A table is broadcast only when its estimated size is below Spark's own broadcast limit.
Beyond that the rows whose id is looked up at all are tried, and stored; if they exceed the limit
too, the join shuffles, with frequent ids and missing ids spread over salts so that
no single id decides the size of a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convfeat.functions.ids import hash_seq
from convfeat.functions.scoring import sigmoid
from convfeat.session import stored

SALTS = 64
HOT_SHARE = 0.002


def fits_broadcast(table: DataFrame) -> bool:
    """Does the optimizer's size estimate of ``table`` lie below the broadcast limit?"""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    estimate = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(estimate)) <= limit


def frequent_ids(df: DataFrame, key: str, share: float = HOT_SHARE) -> list[int]:
    """All ids holding more than ``share`` of the rows, possibly with others; at most 1/share."""
    found = df.select(key).filter(F.col(key).isNotNull()).stat.freqItems([key], share).first()
    return sorted(found[0]) if found and found[0] else []


def needed_table(table: DataFrame, key: str, needed: DataFrame) -> DataFrame | None:
    """``table``, or its rows whose ``key`` occurs in ``needed``; None when those exceed the broadcast limit too."""
    if fits_broadcast(table):
        return table
    if table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() < 0:
        return None
    reduced = stored(table.join(needed.select(key).distinct(), key, "left_semi"), "needed")
    return reduced if fits_broadcast(reduced) else None


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def keyed_join(
    df: DataFrame, table: DataFrame, key: str, spread: Sequence[str], keys_of: DataFrame | None = None
) -> DataFrame:
    """Left join of a table with at most one row per ``key``, whatever share of ``df`` a key holds.

    ``spread`` names columns that tell the rows of ``df`` apart, for salting. ``keys_of`` is a
    cheaper table with about the same keys, to find the frequent ones in.
    """
    small = needed_table(table, key, df) if keys_of is None else table if fits_broadcast(table) else None
    if small is not None:
        return df.join(F.broadcast(small), key, "left")
    hot = frequent_ids(df if keys_of is None else keys_of, key)
    spread_salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    salted = df.withColumn(
        "__salt",
        F.when(F.col(key).isNull() | F.col(key).isin(hot), spread_salt).otherwise(F.lit(0)),
    )
    copies = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    replicated = table.withColumn("__salt", F.explode(copies))
    return salted.join(replicated, [key, "__salt"], "left").drop("__salt")


def lookup(
    df: DataFrame, key: Column, table: DataFrame, spread: Sequence[str], out: str = "vec"
) -> DataFrame:
    """Left join of ``table`` (id, vec) on ``key``; ``out`` is null where the id is missing."""
    keyed = df.withColumn("__id", F.when(key > 0, key.cast("long")))
    vectors = table.select(F.col("id").cast("long").alias("__id"), F.col("vec").cast("array<double>").alias(out))
    return keyed_join(keyed, vectors, "__id", spread).drop("__id")


def lookup_embedding(
    df: DataFrame, id_col: str, table: DataFrame, width: int, spread: Sequence[str], out: str = "vec"
) -> DataFrame:
    """The vector of ``id_col``; the zero vector for id 0 and for unknown ids."""
    found = lookup(df, F.col(id_col), table, spread, out)
    return found.withColumn(out, F.coalesce(out, zeros(width)))


def hashed_lookup(
    df: DataFrame,
    id_col: str,
    table: DataFrame,
    buckets: int,
    gate_logit: float,
    width: int,
    spread: Sequence[str],
    out: str = "vec",
) -> DataFrame:
    """The vector of the id's hash bucket, scaled by the gate."""
    found = lookup(df, F.expr(hash_seq(id_col, buckets)), table, spread, out)
    gate = sigmoid(F.lit(float(gate_logit)))
    return found.withColumn(out, F.coalesce(F.transform(out, lambda x: x * gate), zeros(width)))
