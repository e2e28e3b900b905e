"""Applying a fitted run to samples."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from convfeat.operators.features import convert, project_layout
from convfeat.operators.predictions import last_per_user
from convfeat.plans.inputs import model_input
from convfeat.sources.runs import Run, load_run
from convfeat.sources.samples import read_samples, write_predictions


def score(samples: DataFrame, model: PipelineModel) -> DataFrame:
    """Conversion probability ``prob`` and its ``logit`` for every row; needs no label."""
    scored = model.transform(samples)
    return scored.withColumn("prob", vector_to_array("probability")[1]).withColumn(
        "logit", vector_to_array("rawPrediction")[1]
    )


def score_samples(samples: DataFrame, run: Run, keep: tuple[str, ...] = ("file_path", "row_index")) -> DataFrame:
    """Raw samples -> (user_id, keep, prob)."""
    raw = project_layout(samples, run.layout, keep=keep)
    prepared = model_input(convert(raw, run.layout, training=False, keep=keep), run.layout)
    return score(prepared.select("user_id", *keep, "tokens", "dense"), run.model).select("user_id", *keep, "prob")


def predict_job(spark: SparkSession, run_dir: str, data_dir: str, out_dir: str) -> DataFrame:
    """Score a folder with a stored run, keep each user's last row, write; returns what was written."""
    run = load_run(spark, run_dir, data_dir)
    predictions = last_per_user(score_samples(read_samples(spark, data_dir), run))
    write_predictions(predictions, out_dir)
    return spark.read.schema(predictions.schema).json(out_dir)
