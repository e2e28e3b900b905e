import numpy as np
import pytest
from pyspark.sql import functions as F

from convfeat.operators.distribution import cumulative_sum, order_stat, order_stats
from convfeat.operators.selection import (
    count_ge,
    filter_recent,
    filter_time,
    keep_rank,
    label_of,
    recent_threshold,
    sample_rows,
    shuffle_rows,
    split_block_tail,
    split_overlap_tail,
)
from convfeat.sources.samples import read_samples


def times(spark, values):
    return spark.createDataFrame([(v,) for v in values], "timestamp long")


def test_threshold_uses_float_arithmetic(spark):
    df = times(spark, range(1, 12))
    assert keep_rank(0.9, 11) == 0
    limit = recent_threshold(df, 0.9)
    assert limit == 1 and filter_recent(df, limit).count() == 11


def test_ties_keep_every_row(spark):
    df = times(spark, [5] * 40)
    assert count_ge(df, recent_threshold(df, 0.1)) == 40


def test_missing_time_counts_as_zero(spark):
    df = times(spark, [None, 3, 4])
    assert recent_threshold(df, 1.0) == 0
    assert filter_recent(df, 0).count() == 3


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_order_statistics_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 500, 2000), np.full(1000, 77)])  # a third on one value
    df = times(spark, map(int, values))
    ranks = [0, 1, 999, 1500, len(values) - 1]
    got = order_stats(df, "timestamp", lambda n: ranks, parts)
    assert got == np.sort(values)[ranks].tolist()
    assert order_stat(df, "timestamp", 42) == np.partition(values, 42)[42]


@pytest.mark.parametrize("parts", [1, 4])
def test_cumulative_sum(spark, parts):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: r.v_cum for r in cumulative_sum(df, "k", ["v"], parts).collect()}
    want = np.cumsum([i % 7 for i in range(100)])
    assert [got[i] for i in range(100)] == want.tolist()


def test_overlap_tail_watches_training_rows(spark):
    df = times(spark, range(1000))
    train, valid = split_overlap_tail(df, 0.9, 0.016)
    assert valid.exceptAll(train).count() == 0
    assert train.agg(F.min("timestamp")).first()[0] == keep_rank(0.9, 1000)
    with pytest.raises(ValueError):
        split_overlap_tail(df, 0.0, 0.5)


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(500).withColumnRenamed("id", "timestamp")
    order = F.xxhash64("timestamp")
    first = sample_rows(df, 120, order)
    assert first.count() == 120 and first.exceptAll(sample_rows(df, 120, order)).count() == 0
    assert sample_rows(df, 9999, order).count() == 500


def test_time_filter_is_closed(spark):
    df = times(spark, range(10))
    assert [r[0] for r in filter_time(df, 3, 5).collect()] == [3, 4, 5]
    assert filter_time(df).count() == 10


def test_labels(spark):
    df = spark.createDataFrame([(2,), (1,), (None,)], "t int").coalesce(1)
    assert [tuple(r) for r in df.select(label_of(F.col("t")), label_of(F.col("t"), False)).collect()] == [(1, 0), (0, 0), (0, 0)]


@pytest.fixture
def two_files(spark, tmp_path):
    for name, low in (("a", 0), ("b", 100)):
        rows = spark.range(low, low + 100).select(F.col("id").alias("timestamp"))
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    from pathlib import Path
    folder = tmp_path / "data"
    folder.mkdir()
    for name in ("a", "b"):
        [part] = Path(tmp_path / name).glob("*.parquet")
        (folder / f"{name}.parquet").write_bytes(part.read_bytes())
    return read_samples(spark, str(folder))


def ids(df):
    return sorted(r.timestamp for r in df.collect())


def test_block_split_follows_file_order(two_files):
    train, valid = split_block_tail(two_files, 0.1, block_rows=10)
    assert ids(train) == list(range(180)) and ids(valid) == list(range(180, 200))


def test_shrunken_training_widens_validation(two_files):
    train, valid = split_block_tail(two_files, 0.1, train_ratio=0.5, block_rows=10)
    assert ids(train) == list(range(90)) and ids(valid) == list(range(90, 200))


def test_one_block_leaves_training_empty(two_files):
    train, valid = split_block_tail(two_files.filter("file_path LIKE '%a.parquet'"), 0.1, block_rows=1000)
    assert ids(train) == [] and ids(valid) == list(range(100))


def test_recent_filter_spares_validation(two_files):
    train, valid = split_block_tail(two_files, 0.5, train_recent=0.75, block_rows=10)
    assert ids(train) == list(range(49, 100)) and ids(valid) == list(range(100, 200))


def test_shuffle_keeps_rows_whole(spark):
    df = spark.range(300).select("id", (F.col("id") * 2).alias("twice"))
    first, again = shuffle_rows(df, ["id"], 1).collect(), shuffle_rows(df.repartition(7), ["id"], 1).collect()
    assert first == again and all(r.twice == 2 * r.id for r in first)
    assert [r.id for r in first] != list(range(300))
    assert first != shuffle_rows(df, ["id"], 2).collect()


def test_sample_of_equal_rows(spark):
    from pyspark.sql import functions as F

    from convfeat.operators.selection import sample_rows

    df = spark.range(100).selectExpr("7L as timestamp", "id % 3 as k")
    assert sample_rows(df, 10, F.lit(1)).count() == 10
    assert sample_rows(df, 70, F.xxhash64("k")).count() == 70
    assert sample_rows(df, 500, F.xxhash64("k")).count() == 100


@pytest.mark.parametrize("spread", [3, 10**6, 2**62])
def test_order_stats_by_refinement_equal_sorting(spark, spread):
    """Ties, negatives, 64-bit extremes and nulls (ranked first) against a sorted list."""
    import random

    from convfeat.operators.distribution import order_stats

    rng = random.Random(spread)
    values = [rng.randint(-spread, spread) for _ in range(3000)] + [-(2**63), 2**63 - 1, 0, 0, 0] + [None] * 7
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    ordered = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
    ranks = [0, 6, 7, 8, 1500, len(values) // 3, len(values) - 2, len(values) - 1]
    assert order_stats(df, "v", lambda n: ranks) == [ordered[r] for r in ranks]


@pytest.mark.parametrize("valid_ratio, train_ratio", [(0.1, 1.0), (0.3, 0.5), (0.95, 1.0)])
def test_block_boundary_over_many_files(spark, valid_ratio, train_ratio):
    """Thirty files of uneven sizes: the boundary equals the running count of blocks in file order."""
    from convfeat.operators.selection import block_boundary

    sizes = {f"f{k:02d}": 1 + (k * 37) % 55 for k in range(30)}
    rows = [(name, i) for name, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "file_path string, row_index long").repartition(4)
    blocks = {name: -(-n // 7) for name, n in sizes.items()}
    total = sum(blocks.values())
    train_blocks = total - max(1, int(total * valid_ratio))
    if train_ratio < 1.0:
        train_blocks = max(1, int(train_blocks * train_ratio))
    want, end = None, 0
    for name in sorted(blocks):
        if end + blocks[name] > train_blocks:
            want = (name, (train_blocks - end) * 7)
            break
        end += blocks[name]
    assert block_boundary(df, valid_ratio, train_ratio, 7) == want


def test_sample_by_place_reads_one_column_and_repeats(spark, tmp_path):
    """Hashing places: the scan reads the time column only, n is exact and the sample repeats."""
    from convfeat.operators.selection import place_order, sample_rows

    wide = spark.range(300).select(F.col("id").alias("timestamp"), F.repeat(F.lit("x"), 50).alias("payload"), (F.col("id") * 2).alias("other"))
    wide.repartition(3).write.parquet(str(tmp_path / "wide"))
    df = read_samples(spark, str(tmp_path / "wide"))
    picked = sample_rows(df, 77, place_order(df))
    first = sorted(r.timestamp for r in picked.select("timestamp").collect())
    assert len(first) == 77 and first == sorted(r.timestamp for r in picked.select("timestamp").collect())
    plan = picked.select("timestamp")._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema: struct<")[1].rstrip(">").split(",") for line in plan.splitlines() if "ReadSchema" in line]
    data = {field.split(":")[0] for fields in read for field in fields if not field.startswith("_tmp_metadata")}
    assert read and data == {"timestamp"}
