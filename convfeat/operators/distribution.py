"""Ordered computations over a whole column without sending it through one task.

The rows are range-partitioned once and stored together with their partition number, so the
number means the same rows for every later reader. What then crosses partitions is one
summary row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convfeat.session import cut

CHUNK = "__chunk"


def range_chunks(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` split into sorted ranges of ``order``; column ``__chunk`` numbers the ranges."""
    sized = [parts] if parts else []
    ranged = df.repartitionByRange(*sized, *order)
    return cut(ranged.withColumn(CHUNK, F.spark_partition_id()))


def _chunk_totals(chunks: DataFrame, values: Sequence[str]) -> list[list[int | float]]:
    """Per value column: totals indexed by chunk number. One collected row per partition."""
    rows = chunks.groupBy(CHUNK).agg(*[F.sum(v).alias(v) for v in values]).collect()
    count = max((row[CHUNK] for row in rows), default=-1) + 1
    totals = [[0] * count for _ in values]
    for row in rows:
        for i, v in enumerate(values):
            totals[i][row[CHUNK]] = row[v]
    return totals


def _by_chunk(numbers: Sequence[int | float], kind: str) -> Column:
    """Constant array of one number per chunk, read at the row's chunk."""
    listed = F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")
    return F.get(listed, F.col(CHUNK))


def cumulative_sum(
    df: DataFrame, key: str, values: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Inclusive running sums ``<value>_cum`` in the order of ``key``; one row per key expected."""
    chunks = range_chunks(df.select(key, *values), [key], parts)
    kinds = dict(chunks.dtypes)
    running = Window.partitionBy(CHUNK).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    columns = [F.col(key), *map(F.col, values)]
    for value, totals in zip(values, _chunk_totals(chunks, values)):
        offsets = list(accumulate(totals, initial=0))
        columns.append((_by_chunk(offsets, kinds[value]) + F.sum(value).over(running)).alias(f"{value}_cum"))
    return chunks.select(*columns)


#: Buckets per cell and round of the histogram refinement.
CELLS = 1 << 16
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _refined(df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]]) -> list[int | None]:
    """Order statistics of an integral column by histogram refinement.

    A first pass counts rows and nulls and finds the smallest and largest value. Each further pass
    counts, for every cell that still holds a wanted rank, its rows in ``CELLS`` equal buckets
    (partial aggregation; at most cells x ``CELLS`` rows reach the driver); a rank's cell shrinks to
    the bucket that holds it. A 64-bit range needs at most four such passes. Nulls rank first.
    """
    value = F.col(column).cast("decimal(20,0)")
    first = df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("present"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if not first["n"]:
        raise ValueError(f"no rows to rank by {column!r}")
    nulls = first["n"] - first["present"]
    wanted = list(ranks(first["n"]))
    found: dict[int, int | None] = {i: None for i, rank in enumerate(wanted) if rank < nulls}
    open_ = {i: (int(first["lo"]), int(first["hi"]), rank - nulls) for i, rank in enumerate(wanted) if rank >= nulls}
    while open_:
        for i, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[i] = lo
                del open_[i]
        if not open_:
            break
        cells = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        cell = F.lit(None).cast("int")
        bucket = F.lit(None).cast("long")
        for j, (lo, hi) in enumerate(reversed(cells)):
            inside = value.between(F.lit(lo).cast("decimal(20,0)"), F.lit(hi).cast("decimal(20,0)"))
            cell = F.when(inside, F.lit(len(cells) - 1 - j)).otherwise(cell)
            scaled = F.expr(f"(({column} - CAST({lo} AS DECIMAL(20,0))) * {CELLS}) div CAST({hi - lo + 1} AS DECIMAL(20,0))")
            bucket = F.when(inside, scaled.cast("long")).otherwise(bucket)
        counted = df.select(cell.alias("cell"), bucket.alias("bucket")).where(F.col("cell").isNotNull())
        counts: dict[int, list[tuple[int, int]]] = {}
        for row in counted.groupBy("cell", "bucket").count().collect():
            counts.setdefault(row["cell"], []).append((row["bucket"], row["count"]))
        for i, (lo, hi, rank) in list(open_.items()):
            size, below = hi - lo + 1, 0
            for b, n in sorted(counts[cells.index((lo, hi))]):
                if below + n > rank:
                    open_[i] = (lo + -(-b * size // CELLS), lo + -(-(b + 1) * size // CELLS) - 1, rank - below)
                    break
                below += n
    return [found[i] for i in range(len(wanted))]


def order_stats(
    df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]], parts: int | None = None
) -> list[int]:
    """Exact order statistics of a column; ``ranks`` maps the row count to 0-based ranks.

    Integral columns go by histogram refinement (``_refined``): passes over the column, no range
    shuffle and no stored copy. Other columns count equal values before the shuffle, and only
    the range that holds a rank is ordered.
    """
    if dict(df.select(column).dtypes)[column] in _INTEGRAL:
        return _refined(df, column, ranks)
    return _ranged(df, column, ranks, parts)


def _ranged(
    df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]], parts: int | None = None
) -> list[int]:
    """Exact order statistics of a column; ``ranks`` maps the row count to 0-based ranks.

    Equal values are counted together before the shuffle, and only the chunk that holds a
    rank is ordered.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    chunks = range_chunks(counts, [column], parts)
    totals = _chunk_totals(chunks, ["__n"])[0]
    ends = list(accumulate(totals))
    if not ends:
        raise ValueError(f"no rows to rank by {column!r}")
    wanted = list(ranks(ends[-1]))
    running = Window.partitionBy(CHUNK).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    places = [next(i for i, end in enumerate(ends) if end > rank) for rank in wanted]
    summed = chunks.filter(F.col(CHUNK).isin(*places)).withColumn("__cum", F.sum("__n").over(running))
    picked = summed.agg(
        *[
            F.min(
                F.when((F.col(CHUNK) == place) & (F.col("__cum") > rank - (ends[place] - totals[place])), F.col(column))
            ).alias(f"r{i}")
            for i, (rank, place) in enumerate(zip(wanted, places))
        ]
    ).first()
    return list(picked)


def order_stat(df: DataFrame, column: str, kth: int) -> int:
    """The ``kth`` smallest value, counted from 0."""
    return order_stats(df, column, lambda n: [kth])[0]
