import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from convfeat.catalog.jobs import MODEL_LAYOUT, STREAM_LAYOUT
from convfeat.fixtures.samples import samples
from convfeat.operators.features import convert
from convfeat.plans.inputs import model_input
from convfeat.plans.scoring import predict_job, score
from convfeat.plans.training import TrainConfig, evaluate, fit_conversion, train_job
from convfeat.sources.runs import load_run
from convfeat.sources.samples import write_features
from convfeat.streaming.features import feature_stream, run_to_parquet, sample_stream
from convfeat.streaming.scoring import current_predictions, score_stream

SF = "/root/testdata/sf0.001"
FIT = {"hash_size": 256, "iterations": 5}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "samples")
    write_features(samples(spark, SF, ("user", "item", "dense")).repartition(4), path)
    return path


@pytest.fixture(scope="module")
def run_dir(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    metrics = train_job(spark, MODEL_LAYOUT, TrainConfig(data, path, valid_ratio=0.3, alpha=0.4, fit=FIT)).first()
    assert 0.0 < metrics.auc < 1.0 and 0.0 < metrics.logloss < 5.0
    return path


def test_run_round_trip(spark, run_dir):
    run = load_run(spark, run_dir, defaults={"kind": "?", "extra": 1})
    assert run.layout == MODEL_LAYOUT
    assert run.config["kind"] == "logistic" and run.config["extra"] == 1


@pytest.mark.parametrize("kind", ["logistic", "factorisation"])
def test_fitting_converts_every_sample_once(spark, kind):
    seen = spark.sparkContext.accumulator(0)

    def words(i):
        seen.add(1)
        return [f"user1={i % 7}"]

    rows = spark.range(0, 60, 1, 3).select(
        (F.col("id") % 2).cast("int").alias("label"), F.udf(words, "array<string>")("id").alias("tokens"), array_to_vector(F.array(F.col("id") / 60)).alias("dense")
    )
    model = fit_conversion(rows, kind, hash_size=16, iterations=3)
    assert seen.value == 60 and score(rows, model).count() == 60


def test_fit_and_score_share_one_conversion(spark, monkeypatch):
    import convfeat.catalog.jobs as jobs

    calls, keep = [], jobs.convert
    monkeypatch.setattr(jobs, "convert", lambda *given, **more: (calls.append(1), keep(*given, **more))[1])
    out = jobs.fit_score(spark, SF)
    assert len(calls) == 1 and "user_int_feats" not in out._jdf.queryExecution().executedPlan().toString()


def test_stream_batches_are_dealt_anew(spark, run_dir, data, tmp_path, monkeypatch, setting):
    """A batch of one file scores in several tasks, and gives the batch job's predictions."""
    import convfeat.streaming.scoring as scoring

    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_features(spark.read.parquet(data).coalesce(1), str(tmp_path / "one"))
    parts, scored = [], scoring.score_samples
    monkeypatch.setattr(scoring, "score_samples", lambda batch, run: (parts.append(batch.select(F.spark_partition_id()).distinct().count()), scored(batch, run))[1])
    stream = sample_stream(spark, str(tmp_path / "one"), spark.read.parquet(data).schema, files_per_batch=2)
    score_stream(stream, load_run(spark, run_dir), str(tmp_path / "sink"), str(tmp_path / "offsets"))
    expected = predict_job(spark, run_dir, str(tmp_path / "one"), str(tmp_path / "predictions"))
    key = lambda r: r.user_id
    got = sorted(current_predictions(spark, str(tmp_path / "sink")).collect(), key=key)
    assert [tuple(r) for r in got] == [(r.user_id, pytest.approx(r.prob)) for r in sorted(expected.collect(), key=key)]
    assert max(parts) > 1


def test_layout_falls_back_to_the_data_folder(spark, run_dir, tmp_path):
    import shutil

    shutil.copytree(f"{run_dir}/model", tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        load_run(spark, str(tmp_path))
    (tmp_path / "schema.json").write_text(MODEL_LAYOUT.to_json())
    run = load_run(spark, str(tmp_path), str(tmp_path), {"kind": "logistic"})
    assert run.layout == MODEL_LAYOUT and run.config == {"kind": "logistic"}


def test_empty_samples_are_scored_and_evaluated(spark, data, run_dir):
    none = spark.read.parquet(data).filter("timestamp < 0")
    df = model_input(convert(none, MODEL_LAYOUT), MODEL_LAYOUT).select("label", "tokens", "dense")
    model = load_run(spark, run_dir).model
    assert score(df, model).count() == 0
    assert evaluate(df, model).first().asDict() == {"auc": 0.0, "logloss": float("inf")}


def test_block_split_training(spark, data, tmp_path):
    config = TrainConfig(data, str(tmp_path), split="block_tail", valid_ratio=0.3, block_rows=50, fit=FIT)
    assert train_job(spark, MODEL_LAYOUT, config).count() == 1


def test_stream_scores_equal_batch_predictions(spark, data, run_dir, tmp_path):
    batch = predict_job(spark, run_dir, data, str(tmp_path / "batch"))
    stream = sample_stream(spark, data, spark.read.parquet(data).schema, files_per_batch=1)
    score_stream(stream, load_run(spark, run_dir), str(tmp_path / "sink"), str(tmp_path / "offsets"))
    live = current_predictions(spark, str(tmp_path / "sink"))
    assert batch.count() == batch.select("user_id").distinct().count() == live.count()
    wrong = batch.join(live.withColumnRenamed("prob", "live"), "user_id").filter(F.abs(F.col("prob") - F.col("live")) > 1e-9)
    assert wrong.count() == 0


def test_stream_features_equal_batch(spark, data, tmp_path):
    schema = spark.read.parquet(data).schema
    stream = feature_stream(sample_stream(spark, data, schema), STREAM_LAYOUT, keep=("sample_id",))
    run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "offsets"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = convert(spark.read.parquet(data), STREAM_LAYOUT, keep=("sample_id",))
    assert got.count() == want.count() == 600
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_factorisation_model(spark, data):
    df = model_input(convert(spark.read.parquet(data), MODEL_LAYOUT), MODEL_LAYOUT).select("label", "tokens", "dense")
    model = fit_conversion(df, "factorisation", hash_size=64, iterations=3)
    assert score(df, model).filter("prob BETWEEN 0 AND 1").count() == 600
    with pytest.raises(ValueError):
        fit_conversion(df, "factorisation", alpha=0.2)
    with pytest.raises(ValueError):
        fit_conversion(df, "forest")


def test_keyed_upsert_in_any_batch_order(spark, tmp_path):
    """Batches out of order and repeated give each user's last row; the sink holds one row per user."""
    from convfeat.streaming.scoring import KEEP_VERSIONS, upsert_batch

    rng = np.random.default_rng(3)
    rows = [(int(u), f"f{f}", int(r), float(rng.random())) for f in range(6) for r in range(20) for u in rng.integers(0, 15, 1)]
    schema = "user_id long, file_path string, row_index long, prob double"
    batches = {f: spark.createDataFrame([x for x in rows if x[1] == f"f{f}"], schema) for f in range(6)}
    sink = str(tmp_path / "sink")
    for batch_id, f in enumerate([3, 0, 5, 1, 4, 2]):
        upsert_batch(batches[f], sink, batch_id)
    upsert_batch(batches[2], sink, 5)  # the last batch once more, as after a failure
    live = {r.user_id: r.prob for r in current_predictions(spark, sink).collect()}
    want = {}
    for user, path, row, prob in sorted(rows, key=lambda x: (x[1], x[2])):
        want[user] = prob
    assert live == want
    versions = spark.read.parquet(sink + "/v=0").count()
    assert versions == 0 and KEEP_VERSIONS == 2  # emptied: the sink follows the users
    # a version written but never committed stays invisible
    spark.createDataFrame([(999, "f9", 0, 0.5)], schema).write.parquet(sink + "/v=6")
    assert {r.user_id: r.prob for r in current_predictions(spark, sink).collect()} == want
