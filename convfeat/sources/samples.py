"""Parquet samples in, features, predictions and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a folder or file, with the place of each row in ``file_path`` and ``row_index``."""
    samples = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    return samples.select("*", "_metadata.file_path", "_metadata.row_index")


def write_features(df: DataFrame, path: str, split: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """One JSON object ``{"user_id": ..., "prob": ...}`` per line, in as many files as tasks."""
    df.select("user_id", "prob").write.mode("overwrite").json(path)


def write_oob_report(df: DataFrame, path: str) -> None:
    df.orderBy("feature_group", "fid").write.mode("overwrite").option("header", True).csv(path)
