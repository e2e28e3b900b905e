"""Row-wise losses of a logit against a 0/1 label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """Logistic function; exp never overflows."""
    decay = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + decay)).otherwise(decay / (F.lit(1.0) + decay))


def bce_with_logit(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_term(z: Column, y: Column, alpha: float = 0.1, gamma: float = 2.0) -> Column:
    """Cross entropy weighted down where the prediction is already right."""
    p = sigmoid(z)
    hit = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    weight = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return weight * F.pow(F.lit(1.0) - hit, F.lit(gamma)) * bce_with_logit(z, y)
