"""What the classifiers read."""

from __future__ import annotations

from pyspark.ml.feature import VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.functions import arrays as A
from convfeat.layout import FeatureLayout
from convfeat.operators.features import dense_groups

# The dense features by meaning.
DENSE_GROUPS = {
    "embedding": (61, 87),
    "statistic": (62, 63, 64, 65, 66),
    "trend": (89, 90, 91),
}


def _words(prefix: str, ids: str) -> str:
    return A.mapped(f"filter({ids}, x -> x > 0)", lambda x: f"concat('{prefix}', string({x}))")


def _word(prefix: str, value: str) -> str:
    return f"CASE WHEN {value} > 0 THEN array(concat('{prefix}', string({value}))) ELSE array() END"


def id_tokens(layout: FeatureLayout) -> str:
    """Every present id of both sides as a word ``<side><fid>=<id>``."""
    return A.joined(
        [
            _words(f"{side}{feature.fid}=", column) if feature.dim > 1 else _word(f"{side}{feature.fid}=", column)
            for side in ("user", "item")
            for feature in layout.side_features(side)
            for column in [layout.id_column(side, feature.fid)]
        ]
    )


def dense_width(layout: FeatureLayout) -> int:
    """Numbers in ``dense``: an absent group is one zero, trend segments are as long as the longest."""
    dims = {f.fid: f.dim for f in layout.user_dense if f.dim > 0}
    groups = {name: [dims[fid] for fid in fids if fid in dims] for name, fids in DENSE_GROUPS.items()}
    trend = groups.pop("trend")
    return sum(sum(group) or 1 for group in groups.values()) + (len(trend) * max(trend) if trend else 1)


def model_input(converted: DataFrame, layout: FeatureLayout) -> DataFrame:
    """Converted samples with the columns the pipeline reads: ``tokens`` and ``dense``.

    The width of ``dense`` is declared, so no row is needed to find it and empty samples can be scored.
    """
    grouped = dense_groups(converted, layout, **DENSE_GROUPS)
    dense = F.concat("dense_embedding", "dense_statistic", F.flatten("dense_trend"))
    filled = grouped.withColumn("tokens", F.expr(id_tokens(layout))).withColumn("dense", array_to_vector(dense))
    return VectorSizeHint(inputCol="dense", size=dense_width(layout), handleInvalid="error").transform(filled)
