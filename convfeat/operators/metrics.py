"""Ranking and loss metrics of scored samples. Each returns a one-row DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.functions.scoring import bce_with_logit, focal_term
from convfeat.operators.distribution import cumulative_sum


def auc(df: DataFrame, score: str, label: str, parts: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. 0.0 without both classes."""
    counts = (
        df.filter(~F.isnan(score))
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    )
    ranked = cumulative_sum(counts, "score", ["pos", "neg"], parts)
    below = F.col("neg_cum").cast("double") - F.col("neg").cast("double") / 2
    return ranked.agg(
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("n"),
        F.sum(F.col("pos").cast("double") * below).alias("won"),
    ).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / F.col("p") / F.col("n")).otherwise(0.0).alias("auc"))


def logloss(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean cross entropy over rows with a number as logit; infinity without any."""
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    mean = F.avg(F.when(~F.isnan(z), bce_with_logit(z, y)))
    return df.agg(F.coalesce(mean, F.lit(float("inf"))).alias("logloss"))


def focal_loss(
    df: DataFrame,
    logit: str,
    label: str,
    alpha: float = 0.1,
    gamma: float = 2.0,
    reduction: str = "mean",
) -> DataFrame:
    """Focal loss: ``mean`` or ``sum`` over the rows, or ``none`` for one added column."""
    term = focal_term(F.col(logit).cast("double"), F.col(label).cast("double"), alpha, gamma)
    if reduction == "none":
        return df.withColumn("focal_loss", term)
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction!r}")
    return df.agg((F.avg(term) if reduction == "mean" else F.sum(term)).alias("focal_loss"))
