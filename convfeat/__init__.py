"""Conversion-prediction features, sample selection, pooling and metrics on Spark."""

from convfeat.layout import DenseFeature, FeatureLayout, IdFeature, SequenceDomain

__all__ = ["DenseFeature", "FeatureLayout", "IdFeature", "SequenceDomain"]
