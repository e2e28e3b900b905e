"""Fitting and evaluating a conversion classifier with Spark ML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convfeat.layout import FeatureLayout
from convfeat.operators.features import convert, project_layout
from convfeat.operators.metrics import auc, logloss
from convfeat.operators.selection import split_block_tail, split_overlap_tail
from convfeat.plans.inputs import model_input
from convfeat.plans.scoring import score
from convfeat.session import cut, stored
from convfeat.sources.runs import Run, save_run
from convfeat.sources.samples import read_samples

def fit_conversion(
    samples: DataFrame,
    kind: str = "logistic",
    alpha: float | None = None,
    hash_size: int = 1 << 18,
    iterations: int = 50,
    regularisation: float = 1e-4,
    seed: int = 42,
) -> PipelineModel:
    """Fit on the columns of ``model_input``.

    The vectors are stored once; the passes of the classifier read them and convert no sample again.
    ``logistic`` is a linear model; ``factorisation`` adds pairwise id interactions. ``alpha``
    weights conversions against the other rows (logistic only).
    """
    stages = [
        HashingTF(inputCol="tokens", outputCol="hashed_ids", numFeatures=hash_size, binary=True),
        VectorAssembler(inputCols=["hashed_ids", "dense"], outputCol="features"),
    ]
    weights = []
    if kind == "logistic":
        model = LogisticRegression(maxIter=iterations, regParam=regularisation)
        if alpha is not None:
            weights = [F.when(F.col("label") == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha)).alias("weight")]
            model = model.setWeightCol("weight")
    elif kind == "factorisation":
        if alpha is not None:
            raise ValueError("class weights need the logistic model")
        model = FMClassifier(maxIter=iterations, regParam=regularisation, factorSize=4, stepSize=0.05, seed=seed)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    vectors = stored(PipelineModel(stages).transform(samples).select("label", "features", *weights), "fit")
    return PipelineModel([*stages, model.fit(vectors)])


def evaluate(samples: DataFrame, model: PipelineModel) -> DataFrame:
    """One row: ``auc`` and ``logloss`` of the model on labelled model input."""
    scored = cut(score(samples, model).select("prob", "logit", "label"))
    return auc(scored, "prob", "label").select(
        "auc", F.lit(logloss(scored, "logit", "label").first()[0]).alias("logloss")
    )


@dataclass(frozen=True)
class TrainConfig:
    data_dir: str
    run_dir: str
    split: str = "overlap_tail"
    train_recent: float = 0.90
    valid_ratio: float = 0.016
    train_ratio: float = 1.0
    block_rows: int = 1_000_000
    kind: str = "logistic"
    alpha: float | None = None
    fit: dict = field(default_factory=dict)


def split_samples(samples: DataFrame, config: TrainConfig) -> tuple[DataFrame, DataFrame]:
    if config.split == "overlap_tail":
        return split_overlap_tail(samples, config.train_recent, config.valid_ratio)
    if config.split == "block_tail":
        return split_block_tail(
            samples, config.valid_ratio, config.train_ratio, config.train_recent, config.block_rows
        )
    raise ValueError(f"unknown split {config.split!r}")


def train_job(spark: SparkSession, layout: FeatureLayout, config: TrainConfig) -> DataFrame:
    """Read, split, convert, fit, evaluate, save; returns the metrics row."""
    samples = read_samples(spark, config.data_dir)
    place = ("file_path", "row_index")
    train, valid = split_samples(project_layout(samples, layout, keep=place), config)

    def prepared(df: DataFrame) -> DataFrame:
        return model_input(convert(df, layout), layout).select("label", "tokens", "dense")

    model = fit_conversion(prepared(train), config.kind, config.alpha, **config.fit)
    metrics = evaluate(prepared(valid), model)
    save_run(spark, Run(model, layout, asdict(config)), config.run_dir)
    return metrics
