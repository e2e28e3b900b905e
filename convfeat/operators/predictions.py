"""One prediction per user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_user(
    df: DataFrame, order: Sequence[str] = ("file_path", "row_index"), value: str = "prob"
) -> DataFrame:
    """The value of each user's last row in ``order``; combined before the shuffle."""
    return df.groupBy("user_id").agg(F.max_by(value, F.struct(*order)).alias(value))
