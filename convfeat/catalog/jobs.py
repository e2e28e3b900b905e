"""Training, scoring and streaming jobs over the derived samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from convfeat.catalog import sql as S
from convfeat.catalog.registry import query
from convfeat.fixtures.samples import LAYOUT, samples, seconds, table
from convfeat.layout import ITEM_HASH_FID, SAMPLE_CLOCK_FIDS, FeatureLayout
from convfeat.operators.features import convert
from convfeat.operators.selection import split_overlap_tail
from convfeat.plans.inputs import model_input
from convfeat.plans.scoring import predict_job, score
from convfeat.plans.training import TrainConfig, fit_conversion, train_job
from convfeat.session import scratch_path, stored
from convfeat.sources.runs import load_run
from convfeat.sources.samples import read_samples, write_features
from convfeat.streaming.features import feature_stream, run_to_parquet, sample_stream
from convfeat.streaming.scoring import current_predictions, score_stream

# The classifiers read id and dense features; sequences enter through the matching operators.
MODEL_LAYOUT = FeatureLayout(
    user_ids=LAYOUT.user_ids,
    item_ids=LAYOUT.item_ids,
    user_dense=LAYOUT.user_dense,
    sample_clock=True,
    item_buckets=LAYOUT.item_buckets,
)
FIT = {"hash_size": 4096, "iterations": 20}


def _raw(spark, sf_dir):
    """The derived samples written out as a data folder."""
    path = scratch_path(spark, "samples")
    write_features(samples(spark, sf_dir, ("user", "item", "dense")), path)
    return path


@query("fit_score")
def fit_score(spark, sf_dir):
    """Fit on the latest 90 %, score every sample; each is converted once, for both."""
    raw = spark.read.parquet(_raw(spark, sf_dir))
    converted = model_input(convert(raw, MODEL_LAYOUT, keep=("sample_id",)), MODEL_LAYOUT)
    every = stored(converted.select("sample_id", "timestamp", "label", "tokens", "dense"), "converted")
    train, _ = split_overlap_tail(every, 0.90, 0.016)
    model = fit_conversion(train, alpha=0.4, **FIT)
    return score(every, model).select("sample_id", "label", "prob")


@query("train_predict")
def train_predict(spark, sf_dir):
    """Train from a folder, store the run, load it, predict for a folder, read the predictions."""
    data, run = _raw(spark, sf_dir), scratch_path(spark, "run")
    train_job(spark, MODEL_LAYOUT, TrainConfig(data, run, fit=FIT))
    return predict_job(spark, run, data, scratch_path(spark, "predictions"))


@query("stream_scores")
def stream_scores(spark, sf_dir):
    """Train from a folder, then score the folder as a stream."""
    data, run = _raw(spark, sf_dir), scratch_path(spark, "run")
    train_job(spark, MODEL_LAYOUT, TrainConfig(data, run, fit=FIT))
    stream = sample_stream(spark, data, spark.read.parquet(data).schema, files_per_batch=2)
    sink = scratch_path(spark, "scores")
    score_stream(stream, load_run(spark, run), sink, scratch_path(spark, "offsets"))
    return current_predictions(spark, sink)


STREAM_LAYOUT = FeatureLayout(sample_clock=True, item_buckets=40)


@query(
    "stream_features",
    f"""WITH {S.samples_sql()} SELECT sample_id, user_id, timestamp, CASE WHEN label_type = 2 THEN 1 ELSE 0 END::int AS label,
  {S.hour("timestamp")} AS hour_id, {S.day("timestamp")} AS day_id,
  CASE WHEN {S.day("timestamp")} >= 6 THEN 2 ELSE 1 END::bigint AS weekend_id,
  ({S.hour("timestamp")} - 1) // 6 + 1 AS daypart_id,
  CASE WHEN item_id > 0 THEN (item_id - 1) % 40 + 1 ELSE 0 END::bigint AS item_hash FROM samples
WHERE timestamp >= 1704499200""",
)
def stream_features(spark, sf_dir):
    """Features of the event file read as a stream, drained into parquet."""
    events = sample_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    raw = events.filter(kind.isin("click", "purchase", "view")).select(
        F.col("event_id").alias("sample_id"),
        seconds().alias("timestamp"),
        F.when(kind == "purchase", 2).when(kind == "click", 1).alias("label_type"),
        "user_id",
        F.when(k != 50, k - 1).alias("item_id"),
    )
    out = scratch_path(spark, "features")
    stream = feature_stream(raw, STREAM_LAYOUT, tmin=1704499200, keep=("sample_id",))
    run_to_parquet(stream, out, scratch_path(spark, "offsets"))
    clock = zip(("hour_id", "day_id", "weekend_id", "daypart_id"), SAMPLE_CLOCK_FIDS)
    return spark.read.parquet(out).select(
        "sample_id",
        "user_id",
        "timestamp",
        "label",
        *[F.col(f"user_int_feats_{fid}").alias(name) for name, fid in clock],
        F.col(f"item_int_feats_{ITEM_HASH_FID}").alias("item_hash"),
    )


@query(
    "sample_places",
    f"""WITH {S.samples_sql("user", "item")} SELECT label_type, count(*) AS row_count, count(item_id) AS items,
  count(user_int_feats_60) AS order_lists FROM samples GROUP BY label_type""",
)
def sample_places(spark, sf_dir):
    """Samples written as a folder and read back with the place of every row."""
    df = read_samples(spark, _raw(spark, sf_dir))
    return df.groupBy("label_type").agg(
        F.count_distinct("file_path", "row_index").alias("row_count"),
        F.count("item_id").alias("items"),
        F.count("user_int_feats_60").alias("order_lists"),
    )
