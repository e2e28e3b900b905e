"""Sample selection, labels and calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from convfeat.catalog import sql as S
from convfeat.catalog.registry import query, rounded, sql_rounded
from convfeat.fixtures.samples import event_facts, samples, seconds, table
from convfeat.functions import calendar as C
from convfeat.operators.selection import (
    count_ge,
    filter_recent,
    filter_time,
    label_of,
    recent_threshold,
    recent_thresholds,
    shuffle_rows,
    split_block_tail,
    split_overlap_tail,
    split_profile,
)

KEEP_TRAIN, KEEP_VALID = 0.90, 0.016
BLOCK_ROWS = 1000


@query(
    "periodic_time",
    f"""WITH {S.FACTS}, kept AS (SELECT *, {S.hour("sec")} AS h, {S.day("sec")} AS d FROM facts
  WHERE sec >= {S.threshold("facts", KEEP_TRAIN)})
SELECT h AS hour_id, d AS day_id, CASE WHEN d >= 6 THEN 2 ELSE 1 END::bigint AS weekend_id,
  (h - 1) // 6 + 1 AS daypart_id, count(*) AS events,
  count(*) FILTER (event_type = 'purchase') AS conversions,
  {sql_rounded("count(*) FILTER (event_type = 'purchase') / count(*)::double")} AS conversion_rate
FROM kept GROUP BY ALL""",
)
def periodic_time(spark, sf_dir):
    """Conversion rate by calendar ids over the latest 90 % of the events."""
    events = table(spark, sf_dir, "events").select(seconds().alias("timestamp"), "event_type")
    recent = filter_recent(events, recent_threshold(events, KEEP_TRAIN))
    clock = zip(("hour_id", "day_id", "weekend_id", "daypart_id"), C.sample_clock("timestamp"))
    grouped = recent.groupBy(*[F.expr(text).alias(name) for name, text in clock]).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("conversions")
    )
    return grouped.withColumn("conversion_rate", rounded(F.col("conversions") / F.col("events")))


@query(
    "time_bucket",
    f"""WITH {S.FACTS} SELECT event_id,
  {S.bucket("1706745600", "sec")} AS to_month_end, {S.bucket("sec", "(sec - k * k * 400)")} AS spread,
  {S.bucket("sec", "(sec + k)")} AS future,
  {S.bucket("sec", "(CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 1 THEN -k ELSE sec - k END)")} AS missing
FROM facts""",
)
def time_bucket(spark, sf_dir):
    """Gap buckets of ordinary, future, missing and negative event times."""
    odd = "CASE WHEN k % 10 = 0 THEN 0 WHEN k % 10 = 1 THEN -k ELSE sec - k END"
    facts = event_facts(spark, sf_dir).selectExpr("event_id", "sec", "k", f"{odd} AS odd")
    return facts.selectExpr(
        "event_id",
        f"{C.time_bucket('1706745600', 'sec')} AS to_month_end",
        f"{C.time_bucket('sec', '(sec - k * k * 400)')} AS spread",
        f"{C.time_bucket('sec', '(sec + k)')} AS future",
        f"{C.time_bucket('sec', 'odd')} AS missing",
    )


@query(
    "label_rate",
    f"""WITH {S.samples_sql()}, lines AS (
  SELECT 'all' AS split, NULL::bigint AS threshold UNION ALL
  SELECT 'train', {S.threshold("samples", KEEP_TRAIN, "timestamp")} UNION ALL
  SELECT 'valid', {S.threshold("samples", KEEP_VALID, "timestamp")})
SELECT split, threshold, count(*) AS row_count, count(*) FILTER (label_type = 2) AS conversions,
  {sql_rounded("count(*) FILTER (label_type = 2) / count(*)::double")} AS conversion_rate
FROM lines JOIN samples ON threshold IS NULL OR timestamp >= threshold GROUP BY split, threshold""",
)
def label_rate(spark, sf_dir):
    """Size and conversion rate of all rows and of both overlapping splits."""
    df = samples(spark, sf_dir)
    train, valid = recent_thresholds(df, [KEEP_TRAIN, KEEP_VALID])
    profile = split_profile(df, {"train": train, "valid": valid}, label_of(F.col("label_type")))
    return profile.withColumn("conversion_rate", rounded(F.col("conversion_rate")))


@query(
    "recent_window",
    f"""WITH {S.samples_sql()} SELECT sample_id, timestamp, CASE WHEN label_type = 2 THEN 1 ELSE 0 END::int AS label
FROM samples WHERE timestamp >= {S.threshold("samples", KEEP_TRAIN, "timestamp")}""",
)
def recent_window(spark, sf_dir):
    """The latest 90 % of the samples with their labels."""
    df = samples(spark, sf_dir)
    recent = filter_recent(df, recent_threshold(df, KEEP_TRAIN))
    return recent.select("sample_id", "timestamp", label_of(F.col("label_type")).alias("label"))


# Portable stand-in for the row hash, so that both engines draw the same sample.
_DRAW = (2_654_435_761, 2026, 4_294_967_296)


@query(
    "sampled_window",
    f"""WITH {S.samples_sql()}, drawn AS (
  SELECT timestamp FROM samples ORDER BY (sample_id * {_DRAW[0]} + {_DRAW[1]}) % {_DRAW[2]}
  LIMIT (SELECT count(*) // 3 FROM samples)),
cut AS (SELECT {S.threshold("drawn", KEEP_TRAIN, "timestamp")} AS threshold)
SELECT threshold, (SELECT count(*) FROM samples WHERE timestamp >= threshold) AS rows_kept FROM cut""",
)
def sampled_window(spark, sf_dir):
    """Threshold from a third of the rows, drawn without replacement."""
    df = samples(spark, sf_dir).select("sample_id", "timestamp")
    factor, shift, modulus = (F.lit(x).cast("long") for x in _DRAW)
    draw = F.pmod(F.col("sample_id") * factor + shift, modulus)
    limit = recent_threshold(df, KEEP_TRAIN, sample_size=df.count() // 3, sample_order=draw)
    kept = count_ge(df, limit)
    return spark.range(1).select(
        F.lit(limit).cast("long").alias("threshold"), F.lit(kept).cast("long").alias("rows_kept")
    )


@query(
    "overlap_tail",
    f"""WITH {S.samples_sql()}
SELECT 'train' AS split, sample_id, timestamp FROM samples
WHERE timestamp >= {S.threshold("samples", KEEP_TRAIN, "timestamp")} UNION ALL
SELECT 'valid', sample_id, timestamp FROM samples
WHERE timestamp >= {S.threshold("samples", KEEP_VALID, "timestamp")}""",
)
def overlap_tail(spark, sf_dir):
    """Training and watched rows; the latter also train."""
    train, valid = split_overlap_tail(samples(spark, sf_dir), KEEP_TRAIN, KEEP_VALID)
    named = [df.select(F.lit(n).alias("split"), "sample_id", "timestamp") for n, df in (("train", train), ("valid", valid))]
    return named[0].unionByName(named[1])


@query(
    "block_tail",
    f"""WITH {S.FACTS}, sizes AS (SELECT ceil(count(*) / {BLOCK_ROWS}.0)::bigint AS blocks FROM facts),
cut AS (SELECT CASE WHEN blocks = 1 THEN 0 END AS never,
  greatest(1, floor((blocks - greatest(1, floor(blocks * 0.25::double))) * 0.5::double))::bigint * {BLOCK_ROWS} AS edge
  FROM sizes)
SELECT 'train' AS split, event_id, sec AS timestamp FROM facts, cut
WHERE event_id < edge AND sec >= {S.threshold("facts", KEEP_TRAIN)} UNION ALL
SELECT 'valid', event_id, sec FROM facts, cut WHERE event_id >= edge""",
)
def block_tail(spark, sf_dir):
    """Split by blocks of rows in file order; half the training blocks, latest 90 % of time."""
    events = table(spark, sf_dir, "events").select(
        "event_id", seconds().alias("timestamp"), "_metadata.file_path", "_metadata.row_index"
    )
    train, valid = split_block_tail(events, 0.25, 0.5, KEEP_TRAIN, BLOCK_ROWS)
    named = [df.select(F.lit(n).alias("split"), "event_id", "timestamp") for n, df in (("train", train), ("valid", valid))]
    return named[0].unionByName(named[1])


@query(
    "filter_time",
    f"""WITH {S.samples_sql()} SELECT user_id, count(*) AS samples, min(timestamp) AS first_ts, max(timestamp) AS last_ts
FROM samples WHERE timestamp BETWEEN 1704499200 AND 1705968000 GROUP BY user_id""",
)
def filter_time_query(spark, sf_dir):
    """Samples per user inside a closed time interval."""
    inside = filter_time(samples(spark, sf_dir), 1704499200, 1705968000)
    return inside.groupBy("user_id").agg(
        F.count("*").alias("samples"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


@query(
    "shuffle_rows",
    f"""WITH {S.samples_sql()} SELECT sample_id, user_id, timestamp,
  CASE WHEN label_type = 2 THEN 1 ELSE 0 END::int AS label FROM samples""",
)
def shuffle_rows_query(spark, sf_dir):
    """All samples in a repeatable random order; rows stay whole."""
    df = samples(spark, sf_dir).select(
        "sample_id", "user_id", "timestamp", label_of(F.col("label_type")).alias("label")
    )
    return shuffle_rows(df, ["sample_id"], seed=42)
