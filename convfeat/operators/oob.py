"""Report of ids outside their vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convfeat.functions import arrays as A
from convfeat.functions.ids import clean_id
from convfeat.layout import FeatureLayout


def _checked(layout: FeatureLayout) -> list[tuple[str, int, int, str]]:
    """(group, fid, vocab, list of ids as the conversion would see them)."""
    found = []
    for side, features in (("user", layout.user_ids), ("item", layout.item_ids)):
        for f in features:
            name = layout.id_column(side, f.fid)
            ids = f"array({clean_id(name)})" if f.dim == 1 else A.pad_ids(name, f.dim)
            found.append((f"{side}_int", f.fid, f.vocab, ids))
    for domain in layout.domains:
        for fid, vocab in domain.side_features:
            found.append((domain.name, fid, vocab, A.pad_ids(domain.column(fid), domain.max_len)))
    return [entry for entry in found if entry[2] > 0]


def oob_stats(df: DataFrame, layout: FeatureLayout) -> DataFrame:
    """Count, smallest and largest id at or above the vocabulary, per feature that has any.

    One aggregation over all features; ids count after truncation, as they would be clipped.
    """
    checked = _checked(layout)
    beyond = df.selectExpr(
        *[f"filter({ids}, x -> x >= {vocab}) AS b{i}" for i, (_, _, vocab, ids) in enumerate(checked)]
    )
    sums = [
        f"sum(bigint(size(b{i}))) AS n{i}, min(array_min(b{i})) AS lo{i}, max(array_max(b{i})) AS hi{i}".split(", ")
        for i in range(len(checked))
    ]
    lines = [
        f"struct('{group}' AS feature_group, {fid}L AS fid, {vocab}L AS vocab, "
        f"n{i} AS oob_count, lo{i} AS oob_min, hi{i} AS oob_max)"
        for i, (group, fid, vocab, _) in enumerate(checked)
    ]
    totals = beyond.agg(*[F.expr(text) for texts in sums for text in texts])
    return totals.selectExpr(f"inline(array({', '.join(lines)}))").filter("oob_count > 0")
