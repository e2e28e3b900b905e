import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from convfeat.operators.metrics import auc, focal_loss, logloss
from convfeat.operators.predictions import last_per_user


def scored(spark, rows):
    return spark.createDataFrame(rows, "prob double, label int")


def value(df):
    return df.first()[0]


def test_auc_edge_cases(spark):
    assert value(auc(scored(spark, []), "prob", "label")) == 0.0
    assert value(auc(scored(spark, [(0.1, 1), (0.2, 1)]), "prob", "label")) == 0.0
    assert value(auc(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]), "prob", "label")) == 0.5
    assert value(auc(scored(spark, [(0.9, 1), (0.1, 0), (float("nan"), 0)]), "prob", "label")) == 1.0


@pytest.mark.parametrize("parts", [1, 5])
def test_auc_equals_spark_evaluator(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(float(p), int(y)) for p, y in zip(rng.integers(0, 60, 800) / 60, rng.integers(0, 2, 800))]
    df = scored(spark, rows)
    want = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0).evaluate(df)
    assert value(auc(df, "prob", "label", parts)) == pytest.approx(want, abs=1e-12)


def test_logloss(spark):
    df = spark.createDataFrame([(0.0, 1), (float("nan"), 0)], "z double, y int")
    assert value(logloss(df, "z", "y")) == pytest.approx(math.log(2))
    assert value(logloss(df.limit(0), "z", "y")) == float("inf")
    extreme = spark.createDataFrame([(800.0, 1), (-800.0, 1)], "z double, y int")
    assert value(logloss(extreme, "z", "y")) == pytest.approx(400.0)


def test_focal_loss(spark):
    rows = [(0.3, 1), (-1.2, 0), (2.0, 0)]
    df = spark.createDataFrame(rows, "z double, y int")
    z, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = 1 / (1 + np.exp(-z))
    cross = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    want = np.where(y == 1, 0.1, 0.9) * (1 - np.where(y == 1, p, 1 - p)) ** 2 * cross
    assert value(focal_loss(df, "z", "y")) == pytest.approx(want.mean())
    assert value(focal_loss(df, "z", "y", reduction="sum")) == pytest.approx(want.sum())
    assert value(focal_loss(df, "z", "y", alpha=0.5, gamma=0.0)) == pytest.approx(cross.mean() / 2)
    assert focal_loss(df, "z", "y", reduction="none").count() == 3
    with pytest.raises(ValueError):
        focal_loss(df, "z", "y", reduction="max")


def test_last_prediction_wins(spark):
    rows = [(1, 0.2, "a", 0), (1, 0.7, "a", 1), (2, 0.4, "b", 0), (2, 0.9, "a", 9)]
    df = spark.createDataFrame(rows, "user_id long, prob double, file_path string, row_index long")
    assert {r.user_id: r.prob for r in last_per_user(df).collect()} == {1: 0.7, 2: 0.4}
