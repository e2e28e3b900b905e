"""Choice of training and validation rows by time, labels, and repeatable shuffles.

Thresholds are resolved first and enter the plan as literals, so the filters reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convfeat.operators.distribution import cumulative_sum, order_stats

SAMPLE_SEED = 2026


def scan_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.select(F.coalesce(F.col(column), F.lit(0).cast("long")).alias(column))


def label_of(label_type: Column, training: bool = True) -> Column:
    """1 for a conversion; always 0 where labels are not to be read."""
    if not training:
        return F.lit(0)
    return (F.coalesce(label_type, F.lit(0)) == 2).cast("int")


def filter_time(
    df: DataFrame, tmin: int | None = None, tmax: int | None = None, column: str = "timestamp"
) -> DataFrame:
    """Rows inside the bounds, both inclusive and both optional."""
    if tmin is not None:
        df = df.filter(F.col(column) >= tmin)
    if tmax is not None:
        df = df.filter(F.col(column) <= tmax)
    return df


def filter_recent(df: DataFrame, threshold: int, column: str = "timestamp") -> DataFrame:
    """Rows from ``threshold`` on; a missing time counts as 0, as it does for the threshold."""
    if threshold > 0:
        return filter_time(df, tmin=threshold, column=column)
    return df.filter(F.coalesce(F.col(column), F.lit(0).cast("long")) >= threshold)


def count_ge(df: DataFrame, threshold: int, column: str = "timestamp") -> int:
    return filter_recent(scan_timestamps(df, column), threshold, column).count()


#: Columns that name a row's place; where a frame has them, they alone decide a sample.
PLACE = ("file_path", "row_index")


def sample_rows(df: DataFrame, n: int, order: Column) -> DataFrame:
    """``n`` rows without replacement: those with the smallest ``order`` (a hash of the row key).

    Found as an order statistic of the hash, so no sorted prefix is gathered anywhere. Rows that
    tie at the last hash are taken in the order of their place (or of all columns), as many as
    are wanting, so the sample is the same in every execution.
    """
    hashed = df.withColumn("__order", order)
    [limit] = order_stats(hashed, "__order", lambda rows: [min(n, rows) - 1])
    below = hashed.filter(F.col("__order") < limit)
    wanting = n - below.count()
    ties = [F.col(c) for c in PLACE] if all(c in df.columns for c in PLACE) else [F.col(f"`{c}`") for c in df.columns]
    tied = hashed.filter(F.col("__order") == limit).orderBy(*ties).limit(wanting)
    return below.unionByName(tied).drop("__order")


def place_order(df: DataFrame, seed: int = SAMPLE_SEED) -> Column:
    """A seeded hash of each row's place when the frame has one, else of all its columns."""
    if all(c in df.columns for c in PLACE):
        return F.xxhash64(*[F.col(c) for c in PLACE], F.lit(seed))
    return F.xxhash64(*df.columns, F.lit(seed))


def keep_rank(keep: float, rows: int) -> int:
    """0-based rank of the oldest row among the latest ``keep`` share, in float arithmetic."""
    return math.floor((1.0 - keep) * (rows - 1))


def recent_thresholds(
    df: DataFrame,
    keeps: Sequence[float],
    column: str = "timestamp",
    sample_size: int = 0,
    sample_order: Column | None = None,
) -> list[int]:
    """Oldest time kept for each share, all from one pass over the time column."""
    for keep in keeps:
        if not 0.0 < keep <= 1.0:
            raise ValueError(f"a kept share must be in (0, 1], got {keep}")
    if sample_size > 0:
        order = sample_order if sample_order is not None else place_order(df)
        df = sample_rows(df, sample_size, order)
    return order_stats(
        scan_timestamps(df, column), column, lambda n: [keep_rank(keep, n) for keep in keeps]
    )


def recent_threshold(df: DataFrame, keep: float, **options) -> int:
    return recent_thresholds(df, [keep], **options)[0]


def split_overlap_tail(
    df: DataFrame, train_recent: float, valid: float, column: str = "timestamp", **options
) -> tuple[DataFrame, DataFrame]:
    """Latest ``train_recent`` share for training, latest ``valid`` share (inside it) to watch."""
    train_min, valid_min = recent_thresholds(df, [train_recent, valid], column, **options)
    return filter_recent(df, train_min, column), filter_recent(df, valid_min, column)


def block_boundary(
    df: DataFrame, valid_ratio: float, train_ratio: float, block_rows: int
) -> tuple[str, int] | None:
    """(file, first row) where validation starts, counting blocks of rows in file order.

    None when training holds every file up to the end. Blocks are counted per file, summed in
    file order by sorted ranges (``cumulative_sum``), and the file that holds the boundary is
    found by one aggregation; a single row reaches the driver, however many files there are.
    """
    sizes = df.groupBy("file_path").agg((F.max("row_index") + 1).alias("rows"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("rows") / F.lit(block_rows)).cast("long")).select("file_path", "blocks")
    total = sizes.agg(F.sum("blocks")).first()[0] or 0
    train_blocks = total - max(1, int(total * valid_ratio))
    if train_ratio < 1.0:
        train_blocks = max(1, int(train_blocks * train_ratio))
    running = cumulative_sum(sizes, "file_path", ["blocks"])
    crossing = running.where(F.col("blocks_cum") > F.lit(train_blocks))
    found = crossing.agg(F.min_by(F.struct("file_path", "blocks_cum", "blocks"), F.col("file_path")).alias("at")).first()["at"]
    if found is None:
        return None
    return found["file_path"], (train_blocks - (found["blocks_cum"] - found["blocks"])) * block_rows


def split_block_tail(
    df: DataFrame,
    valid_ratio: float,
    train_ratio: float = 1.0,
    train_recent: float = 1.0,
    block_rows: int = 1_000_000,
    column: str = "timestamp",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Last blocks in file order for validation, the blocks before them for training.

    A shrunken training share also moves the start of validation. The recent threshold is
    taken over all rows but filters training only. ``df`` carries ``file_path`` and
    ``row_index``; the split is one comparison with a literal, without a join.
    """
    boundary = block_boundary(df, valid_ratio, train_ratio, block_rows)
    if boundary is None:
        train, valid = df, df.filter(F.lit(False))
    else:
        path, row = boundary
        before = (F.col("file_path") < path) | ((F.col("file_path") == path) & (F.col("row_index") < row))
        train, valid = df.filter(before), df.filter(~before)
    if train_recent < 1.0:
        train = filter_recent(train, recent_threshold(df, train_recent, column=column, **options), column)
    return train, valid


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Whole rows in a repeatable random order: sorted by a seeded hash of their key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key)


def split_profile(
    df: DataFrame, thresholds: dict[str, int], label: Column, column: str = "timestamp"
) -> DataFrame:
    """Rows, conversions and conversion rate of each split, and of all rows, from one pass."""
    ts = F.coalesce(F.col(column), F.lit(0).cast("long"))
    parts = {"all": None, **thresholds}
    chosen = {name: F.lit(True) if t is None else ts >= t for name, t in parts.items()}
    sums = []
    for name, inside in chosen.items():
        sums += [
            F.count_if(inside).alias(f"rows_{name}"),
            F.coalesce(F.sum(F.when(inside, label.cast("long"))), F.lit(0).cast("long")).alias(f"conversions_{name}"),
        ]
    lines = [
        F.struct(
            F.lit(name).alias("split"),
            F.lit(t).cast("long").alias("threshold"),
            F.col(f"rows_{name}").alias("row_count"),
            F.col(f"conversions_{name}").alias("conversions"),
        )
        for name, t in parts.items()
    ]
    return (
        df.agg(*sums)
        .select(F.inline(F.array(*lines)))
        .withColumn(
            "conversion_rate",
            F.when(F.col("row_count") > 0, F.col("conversions") / F.col("row_count")).otherwise(F.lit(0.0)),
        )
    )
