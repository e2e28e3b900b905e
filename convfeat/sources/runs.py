"""A training run on disk: the fitted pipeline with its layout and settings beside it."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException

from convfeat.layout import FeatureLayout


@dataclass(frozen=True)
class Run:
    model: PipelineModel
    layout: FeatureLayout
    config: dict[str, Any]


def save_run(spark: SparkSession, run: Run, path: str) -> None:
    run.model.write().overwrite().save(f"{path}/model")
    side = spark.createDataFrame(
        [(run.layout.to_json(), json.dumps(run.config))], "layout string, config string"
    )
    side.coalesce(1).write.mode("overwrite").json(f"{path}/side")


def read_layout(spark: SparkSession, path: str, max_lens: dict[str, int] | None = None) -> FeatureLayout:
    """The layout of a ``schema.json`` side file."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    return FeatureLayout.from_json(text, max_lens)


def load_run(
    spark: SparkSession, path: str, data_dir: str | None = None, defaults: dict[str, Any] | None = None
) -> Run:
    """Layout and settings of the run; where it has none, the data folder's layout and ``defaults``."""
    model = PipelineModel.load(f"{path}/model")
    try:
        side = spark.read.schema("layout string, config string").json(f"{path}/side").first()
    except AnalysisException:
        side = None
    if side is not None:
        config = {**(defaults or {}), **json.loads(side["config"])}
        return Run(model, FeatureLayout.from_json(side["layout"]), config)
    if data_dir is None:
        raise FileNotFoundError(f"run {path} has no layout, and no data folder was given")
    return Run(model, read_layout(spark, f"{data_dir}/schema.json"), dict(defaults or {}))
